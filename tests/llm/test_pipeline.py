import hashlib

import corpus_pipeline as P
from ledgerlume.llm import decontaminate, quality

SMALL = "/root/testdata/sf0.001"


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the one before kept; survivors are worked out in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(texts)
    for n, (name, stage) in enumerate(P.STAGES):
        out = f"{tmp_path}/{n}"
        stage(spark, docs, SMALL).write.parquet(out)
        got = spark.read.parquet(out)
        ids = {r.doc_id for r in got.select("doc_id").collect()}
        assert got.count() == len(ids)
        if name == "quality":
            picked = quality.select(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("selected").collect()
            assert ids == {r.doc_id for r in picked} and len(ids) > 0.7 * len(kept)
        elif name == "exact_dedup":
            assert ids == {max(i for i in kept if texts[i] == texts[k]) for k in kept}
        elif name == "near_dedup":
            sets, root = {i: sets_of(texts[i]) for i in kept}, {i: i for i in kept}
            find = lambda x: x if root[x] == x else find(root[x])
            for i in kept:
                for j in kept:
                    if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
            assert ids == {find(i) for i in kept}
        elif name == "decontaminate":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            items = [r.text for r in bench.collect()]
            assert not {i for i in ids if any(b in texts[i] for b in items)}
            assert kept - ids == {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
        else:
            assert ids == kept
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got.collect())
        if name != "byte_bpe":
            assert got.columns == spark.read.parquet(f"{SMALL}/documents.parquet").columns
        docs, kept = got, ids
    assert {r.doc_id for r in P.run(spark, SMALL).collect()} == kept


def test_quality_stage_counts_every_label(spark):
    """As many rows stay as lie above the level worked out in plain numpy from all labels."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    labelled = quality.with_labels(docs, labels, "quality")
    rows = quality.log_weights(labelled, quality.fit_ratios(labelled)).toPandas()
    known = rows[rows.label.notna()]
    assert len(known) == labels.filter("quality IS NOT NULL").join(docs, "doc_id").count()
    level = quality.best_level(known.unseen_weight.to_numpy(float), known.label.to_numpy() == 1)
    assert P.filter_quality(spark, docs, SMALL).count() == (rows.log_weight >= level).sum()


def test_quality_stage_with_labels_of_any_ids(spark, tmp_path):
    """Labels teach and set the level whatever the hashes of their ids; none of those is a fold of its own."""
    phrase = "IF(id % 3 > 0, 'the river runs along quiet fields ', 'click here to win a prize now ')"
    docs = spark.range(400).selectExpr("id AS doc_id", f"concat(repeat({phrase}, 40), id) AS text")
    for part in range(4):
        some = docs.filter(f"crc32(CAST(doc_id AS string)) % 4 = {part}")
        some.selectExpr("doc_id", "CAST(doc_id % 3 > 0 AS int) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/{part}/labels.parquet")
        kept = {r.doc_id for r in P.filter_quality(spark, docs, f"{tmp_path}/{part}").collect()}
        assert kept == {i for i in range(400) if i % 3 > 0}

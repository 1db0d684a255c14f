import random

import numpy as np

from ledgerlume.llm import decontaminate as D

SMALL = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = (rng.choices(range(6), k=rng.randrange(1, 90)) for _ in range(2))
        assert D.common_subsequence(D.Item.bits(np.array(a)), len(a), b) == lcs(a, b)


def world(seed=2, docs=400, items=30, common=60):
    rng = random.Random(seed)
    frequent = [f"c{i}" for i in range(common)]
    word = lambda: rng.choice(frequent) if rng.random() < 0.5 else f"r{rng.randrange(20000)}"
    bench = [(i, [word() for _ in range(rng.randrange(8, 60))]) for i in range(items)]
    texts, want = [], set()
    for d in range(docs):
        text = [word() for _ in range(rng.randrange(1, 300))]
        kind, item = d % 5, rng.randrange(items)
        words = list(bench[item][1])
        if kind == 1:  # a copy
            want.add((d, item))
        elif kind == 2:  # a paraphrase: words swapped for others, the answer left alone
            for _ in range(len(words) // 6):
                words[rng.randrange(max(1, len(words) - D.ANSWER_WORDS))] = word()
            want.add((d, item))
        elif kind == 3:  # a third of it
            words = words[: len(words) // 3]
        else:
            words = []
        at = rng.randrange(len(text) + 1)
        texts.append((d, " ".join(text[:at] + words + text[at:])))
    return texts, [(i, " ".join(w)) for i, w in bench], want


def frames(spark, texts, bench):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, item_id string"),
        spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, at int"),
    )


def test_planted_copies_and_paraphrases(spark):
    texts, bench, want = world()
    got = {(r.doc_id, r.item_id): r for r in D.matches(*frames(spark, texts, bench)).collect()}
    assert set(got) <= {k for k in got if k in want or brute_share(texts, bench, k) >= D.PARAPHRASE}
    missing = want - set(got)
    assert len(missing) <= 0.01 * len(want), missing
    docs, items = dict(texts), dict(bench)
    for (d, i), r in got.items():  # offsets point at the item
        words = docs[d].split()
        size = len(items[i].split())
        assert lcs(items[i].split(), words[max(0, r.at - 40) : r.at + size + 40]) >= round(r.lcs * size)


def brute_share(texts, bench, key):
    item = dict(bench)[key[1]].split()
    return lcs(item, dict(texts)[key[0]].split()) / len(item)


def test_blocks_of_items_give_the_same_matches(spark, monkeypatch):
    texts, bench, want = world(docs=120)
    docs, items = frames(spark, texts, bench)
    monkeypatch.setattr(D, "ITEM_BLOCK", 8)
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()}
    assert len(want - got) <= 1


def test_all_verbatim_items_of_the_small_tables(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in texts for i, b in bench if b in t}
    got = {(r.doc_id, r.item_id) for r in D.op8_decontaminate(spark, SMALL).collect()}
    assert want and want <= got
    assert all(brute_share(texts, bench, k) >= D.PARAPHRASE for k in got)


def test_recall_of_paraphrases_against_all_windows(spark):
    """Items with an id divisible by 20 against every window of every text, by the same subsequence and answer checks."""
    d = "/root/testdata/sf0.001"
    rng = random.Random(11)
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    pool = [w for _, t in texts for w in t.split()]
    asked = [(i, t.split()) for i, t in bench if i % 20 == 0]
    for n, (i, words) in enumerate((asked * 80)[:80]):
        swapped = list(words)
        for _ in range(int(len(words) * rng.uniform(0.1, 0.38))):
            swapped[rng.randrange(max(1, len(words) - D.ANSWER_WORDS))] = rng.choice(pool)
        host = texts[rng.randrange(200)][1].split()[:400]
        at = rng.randrange(len(host) + 1)
        texts.append((10_000 + n, " ".join(host[:at] + swapped + host[at:])))
    want = set()
    for doc, text in texts:
        all_words = text.lower().split()
        for i, words in asked:
            low = [w.lower() for w in words]
            bits, answer = D.Item.bits(np.array(low)), low[-D.ANSWER_WORDS :]
            slack = D.room(len(low))
            for at in range(0, max(1, len(all_words) - len(low) + 1), D.BLOCK):
                near = all_words[max(0, at - slack) : at + len(low) + slack]
                if sum(map(bits.__contains__, near)) >= D.PARAPHRASE * len(low):
                    share = D.common_subsequence(bits, len(low), near) / len(low)
                    if share >= D.COPY or (share >= D.PARAPHRASE and D.common_subsequence(D.Item.bits(np.array(answer)), len(answer), near) / len(answer) >= D.ANSWER_SHARE):
                        want.add((doc, i))
                        break
    got = {(r.doc_id, r.item_id) for r in D.matches(*frames(spark, texts, bench)).collect() if r.item_id % 20 == 0}
    assert len(want) > 60 and len(want & got) >= 0.9 * len(want), (len(want), len(want & got))


def test_singular_vectors_match_a_plain_decomposition():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 6)) @ rng.standard_normal((6, D.FEATURES + 1)) * 0.1
    a[:, D.FEATURES] = 0
    q = D.orthonormal((a.T @ rng.standard_normal((400, 12))).astype(np.float32))
    got = D.singular_vectors(q, (a.T @ (a @ q)).astype(np.float32), 6)
    true = np.linalg.svd(a, full_matrices=False)[2][:6]
    assert np.allclose(np.abs(true @ got), np.eye(6), atol=2e-2)


def test_long_texts_in_segments_give_the_same_matches(spark, monkeypatch):
    texts, bench, _ = world(docs=60)
    texts = [(i, " ".join(t for _, t in texts[i : i + 12])) for i in range(0, 60, 12)]
    whole = {(r.doc_id, r.item_id) for r in D.matches(*frames(spark, texts, bench)).collect()}
    monkeypatch.setattr(D, "SEGMENT", 256)
    parts = {(r.doc_id, r.item_id) for r in D.matches(*frames(spark, texts, bench)).collect()}
    assert whole and parts == whole


def test_nulls_short_items_answers_long_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    item = " ".join(f"q{i}" for i in range(20))
    texts = [(1, None), (2, ""), (3, long + " " + item.upper()), (3, long + " " + item.upper()), (None, item), (4, "so alpha beta gamma it is"), (5, "alpha gamma beta")]
    bench = [(1, item), (1, item), (2, None), (3, ""), (4, "Alpha beta\ngamma"), (None, "alpha beta")]
    docs, items = frames(spark, texts, bench)
    got = sorted((r.doc_id or -1, r.item_id, round(r.at, -2)) for r in D.matches(docs, items).collect())
    assert got == [(-1, 1, 0), (3, 1, 50_000), (4, 4, 0)]
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]


def test_ids_of_other_types_are_kept(spark):
    words = [f"w{n}" for n in range(60)]
    items = spark.createDataFrame([(7, " ".join(words[:40]))], "item_id long, text string")
    for kind, cast in (("int", int), ("string", str)):
        docs = spark.createDataFrame([(cast(1), " ".join(["x"] * 30 + words[:40])), (cast(2), " ".join(words[50:]))], f"doc_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()] == [(cast(1), 7)]


def test_no_python_workers_for_empty_tables(spark):
    """An empty table made from a list is read by Python workers of its own, beside those of the search."""
    from ledgerlume.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "doc_id long, text string")
    bench = spark.range(1).selectExpr("1L AS item_id", "'q r s t u v w x y z a b c d e f' AS text")
    made = []
    kept = decontaminate.materialise
    try:
        decontaminate.materialise = lambda frame, label, *bound: made.append((label, frame._jdf.queryExecution().toString())) or kept(frame, label, *bound)
        assert decontaminate.matches(docs.coalesce(1), bench).count() == 0
    finally:
        decontaminate.materialise = kept
    plan = dict(made)["matches"]
    assert "Union" not in plan

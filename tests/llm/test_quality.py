import numpy as np
import pytest

from ledgerlume.llm import quality as Q

SMALL = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, label int, log_weight int", "doc_id long, quality int, toxic int"


def test_held_out_labels(spark):
    """Fit on three quarters of the labels and look at the rest."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.selected for r in Q.select(docs, labels.filter("doc_id % 4 > 0")).collect()}
    out = [(r.quality, got[r.doc_id]) for r in labels.filter("doc_id % 4 = 0").collect()]
    good, bad = [s for q, s in out if q == 1], [s for q, s in out if q == 0]
    assert (np.mean(good) > 0.97, np.mean(bad) < 0.25) == (True, True), (np.mean(good), np.mean(bad))
    assert len(got) == docs.count()


def test_weights_match_a_plain_calculation(spark):
    rows = [(1, "a b a", 1), (2, "a ! !", 0), (3, "b b", None), (4, None, 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    ratio = Q.fit_ratio(labelled)
    raw, target = np.zeros(Q.BUCKETS + 1), np.zeros(Q.BUCKETS + 1)
    for _, text, label in rows:
        for f in Q.features([text])[0]:
            raw[f] += 1
            target[f] += label == 1
    spread = Q.SMOOTHING * (Q.BUCKETS + 1)
    share = lambda f: raw[f] / raw.sum()
    want = lambda f: np.log((target[f] + spread * share(f)) / (target.sum() + spread)) - np.log(share(f))
    for r in Q.log_weights(labelled, ratio).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.log_weight == pytest.approx(sum(want(f) for f in Q.features([text])[0]))


@pytest.mark.parametrize("k", [1, 7, 500, 9_999])
def test_kth_key_matches_a_sort(spark, k, monkeypatch):
    monkeypatch.setattr(Q, "FINISH", 16)
    keys = spark.range(10_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 1.5D ELSE (id * 7919 % 1000) / 7D END AS gumbel_key").cache()
    ranked = sorted(((r.gumbel_key, r.doc_id) for r in keys.collect()), key=lambda x: (-x[0], x[1]))
    assert Q.kth_key(keys, k) == ranked[k - 1]


def test_kth_key_with_more_ties_than_are_collected(spark, monkeypatch):
    monkeypatch.setattr(Q, "FINISH", 8)
    monkeypatch.setattr(Q, "BINS", 4)
    keys = spark.range(600).selectExpr("CASE WHEN id % 5 > 0 THEN (id * 37) % 600 END AS doc_id", "CASE WHEN id < 500 THEN 1.0D ELSE 2.0D + id END AS gumbel_key").cache()
    ranked = sorted(((r.gumbel_key, r.doc_id) for r in keys.collect()), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    for k in (1, 100, 101, 300, 420, 500, 501, 600):
        assert Q.kth_key(keys, k) == ranked[k - 1]


def test_draws_follow_the_weights(spark):
    weights = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 2 * 3 AS double) AS log_weight")
    keys = Q.with_keys(weights).orderBy("gumbel_key", ascending=False).limit(400).collect()
    heavy = sum(r.log_weight > 0 for r in keys) / 400
    assert 0.88 < heavy < 0.98  # e^3 : 1, a little less as heavy ones run out


def test_level():
    w = np.array([-9.0, -8, -1, 1, 2])
    assert Q.best_level(w, np.array([False, False, True, True, True])) == -4.0
    assert Q.best_level(w, np.array([True] * 5)) == -np.inf


def test_nulls_repeats_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 1, 1), (2, "", 1, 1), (3, "a b", 1, 1), (3, "a b", 1, 1), (None, "x " * 200_000, 1, 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.selected for r in Q.select(docs, none).collect()] == [True] * 5
    odd = spark.createDataFrame([(3, None, 1), (None, 1, 0), (3, 1, 0), (3, 0, 0), (1, 0, 0)], LABELS)
    assert Q.select(docs, odd).count() == 5 and Q.keep_good(docs, odd).columns == docs.columns
    assert Q.select(docs.limit(0), odd).count() == 0


def test_level_of_all_labels_matches_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART_WEIGHTS", 50)
    rng = np.random.default_rng(5)
    for shift in (0.0, 1.5, 9.0):
        good = rng.random(3000) < 0.6
        weight = np.round(rng.normal(size=3000) + shift * good, 2)  # many equal ones
        known = spark.createDataFrame([(float(w), bool(g)) for w, g in zip(weight, good, strict=True)], "weight double, good boolean")
        assert Q.level_of(known) == Q.best_level(weight, good)
    assert Q.level_of(known.filter("good")) == -np.inf and Q.level_of(known.limit(0)) == -np.inf


def test_every_label_sets_the_level_and_teaches(spark, monkeypatch):
    """No bound on the labels, and no fold of them left out of the level or the model."""
    seen = []
    monkeypatch.setattr(Q, "LEVEL_SAMPLE", 10, raising=False)
    monkeypatch.setattr(Q, "level_of", lambda known: seen.append(known.count()) or 0.0, raising=False)
    monkeypatch.setattr(Q, "best_level", lambda w, good: seen.append(len(w)) or 0.0)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id) AS text", "1 AS label", "1 AS log_weight")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 > 0 AS int) AS quality", "0 AS toxic")
    assert Q.select(docs, labels).count() == 400 and seen == [400]


def test_good_documents_go_by_all_other_good_ones(spark):
    """The unseen weight is that of a model fitted again without the document's own label."""
    rows = [(1, "a b a c", 1), (2, "a ! !", 0), (3, "b b d", 1), (4, None, 1), (5, "e f", None), (6, "a c e", 1), (6, "a c e", 1)]
    fit = lambda some: Q.fit_ratio(spark.createDataFrame(some, "doc_id long, text string, label int").coalesce(1))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = Q.log_weights(labelled, Q.fit_ratios(labelled)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, (_, text, label) = next((n, x) for n, x in enumerate(rows) if x[0] == r.doc_id)
        if label is None:
            assert r.unseen_weight is None
        else:
            without = fit([*rows[:n], (r.doc_id, text, None), *rows[n + 1 :]]) if label else fit(rows)
            assert r.unseen_weight == pytest.approx(float(without[Q.features([text])[0]].sum()))
    alone = spark.createDataFrame([(1, "a b", 1), (2, "c", 0), (3, "", 1)], "doc_id long, text string, label int")
    assert {r.unseen_weight for r in Q.log_weights(alone, Q.fit_ratios(alone)).filter("label = 1").collect()} == {0.0}

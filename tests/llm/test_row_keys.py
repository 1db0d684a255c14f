"""Stages of the pipeline where ids are null or stand for several texts."""

from collections import Counter

import pytest

import corpus_pipeline as P
from ledgerlume.llm import decontaminate, quality

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def rows(spark):
    found = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    base = " ".join(f"wort{i}" for i in range(60))
    more = [(None, base), (None, base + " eins"), (7, base + " zwei drei"), (7, "ganz anders"), (7, "noch ein anderer Text"), (None, "allein"), (None, "auch allein")]
    return sorted({(None if n % 5 == 0 or i == 52 else 7 if n % 5 == 1 or i == 64 else i, t) for n, (i, t) in enumerate(found)} | set(more), key=str)


def kept(spark, rows, stage):
    return Counter((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(rows, KIND), SMALL).collect())


def test_exact_copies(spark, rows):
    best = {}
    for i, t in rows + rows[:20]:
        best.setdefault(t, set()).add(i)
    want = Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in best.items())
    assert kept(spark, rows + rows[:20], P.drop_exact_copies) == want


def test_near_copies(spark, rows):
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min((x for x in (least.get(find(n)), i) if x is not None), default=None)
    assert kept(spark, rows, P.drop_near_copies) == Counter(r for n, r in enumerate(rows) if r[0] == least[find(n)])


def test_contaminated(spark, rows):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    alone = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], KIND)
    gone = {rows[r.doc_id] for r in decontaminate.matches(alone, bench).collect()}
    assert {None, 7} <= {i for i, _ in gone}
    assert kept(spark, rows, P.drop_contaminated) == Counter(r for r in rows if r not in gone)


def test_quality(spark):
    more = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{more}/{t}.parquet") for t in ("documents", "labels"))
    good, bad = ([(r.doc_id, r.text) for r in docs.join(labels.filter(f"quality = {q}"), "doc_id").orderBy("doc_id").collect()] for q in (1, 0))
    other = 10**7  # an id without a label
    rows = good + bad + sorted({(i, t) for i in (None, other) for _, t in good[:20] + bad[:40]}, key=str)
    frame = spark.createDataFrame(rows, KIND)
    want = Counter(r.doc_id for r in quality.select(frame, labels).collect() if r.selected)
    assert all(0 < want[i] < sum(x == i for x, _ in rows) for i in (None, other))
    assert Counter(r.doc_id for r in P.filter_quality(spark, frame, more).collect()) == want

import random

import numpy as np
import pytest

from ledgerlume.llm import minhash as M
from ledgerlume.llm.components import components


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(docs):
    """Class ids by all pairs."""
    sets, root = {i: sets_of(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus(seed, bases=25, most=14):
    """Texts with copies, edited copies, copies of copies and shared passages."""
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(4000)]
    passage, out = rng.choices(vocabulary, k=40), []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.randrange(1, 260))
        if rng.random() < 0.4:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randrange(1, most)):
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
    return [(i, t) for i, t in enumerate(out)]


def classes(spark, docs):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string")
    return {r.doc_id: r.class_id for r in M.near_classes(frame).collect()}


@pytest.mark.parametrize("small, block", [(16, 256), (3, 8)])
def test_classes_match_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK", block)
    docs = corpus(small)
    assert classes(spark, docs) == brute_classes(docs)


def test_one_large_group_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    rng, base = random.Random(3), [f"b{i}" for i in range(150)]
    docs = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    assert classes(spark, docs) == brute_classes(docs)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for scale in (1.0, 6.0):
        elements = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = rng.random(300) * scale, rng.random(300) * scale
        b[:150] = a[:150]
        sig = M.dart_signatures(np.concatenate([elements] * 2), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, k=2048)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 2048)


def test_signatures_do_not_depend_on_order_or_repeats_or_neighbours():
    e = np.arange(50, dtype=np.uint64) * np.uint64(77)
    one = M.dart_signatures(e, np.ones(50), np.zeros(50, int), 1)
    more = M.dart_signatures(np.concatenate([e[:3], e[::-1], e]), np.ones(103), np.repeat([0, 1], [3, 100]), 3)
    assert (one[0] == more[1]).all() and not more[2].any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 3), (7, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(f"t{i}" for i in range(120_000))
    docs = [(4, None), (5, ""), (6, "  \n"), (7, long), (8, long + " end"), (8, long + " end"), (9, "Two words"), (3, "two WORDS"), (None, "two words"), (None, "alone here")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in M.near_classes(frame).collect()), key=str)
    alone = next(c for i, c in got if i is None and c < 0)
    assert got == sorted([(4, 4), (5, 4), (6, 4), (7, 7), (8, 7), (8, 7), (9, 3), (3, 3), (None, 3), (None, alone)], key=str)
    assert M.near_classes(frame.limit(0)).count() == 0
    assert M.keep_one(frame).columns == frame.columns


def test_query_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in M.op4_near_dedup(spark, d).collect()} == brute_classes(docs)

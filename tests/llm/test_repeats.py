import hashlib
import random

import duckdb
import numpy as np
import pytest

from ledgerlume.llm import repeats as R
from ledgerlume.llm.fmindex import FMIndex, WaveletMatrix

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def by_hand(rows, window=20):
    """Rows must come in the order of their files."""
    seen, out = set(), [None] * len(rows)
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, n)):
        words = (rows[n][1] or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[n] = (rows[n][0], len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out, key=repr)


def found(spark, at):
    rows = R.op12_substring_dedup(spark, str(at)).select(COLUMNS)
    assert [t for _, t in rows.dtypes][1:] == ["bigint", "bigint", "string"]
    return sorted(map(tuple, rows.collect()), key=repr)


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    for trial in range(30):
        sizes = rng.integers(0, 60, 12)
        words = rng.integers(1, 2 + trial % 7, sizes.sum()).astype(np.uint64) << np.uint64(40)
        index = FMIndex(words, sizes)
        parts = [words[b - n : b].tolist() for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
        stream = np.concatenate([words[:40], rng.integers(1, 9, 30).astype(np.uint64) << np.uint64(40)])
        ends = np.arange(len(stream) + 1)
        matched, low, high = index.matches(stream, ends, 6)
        for e, m, a, b in zip(ends.tolist(), matched.tolist(), low.tolist(), high.tolist(), strict=True):
            occurs = lambda k: sum(p[i : i + k] == stream[e - k : e].tolist() for p in parts for i in range(len(p) - k + 1))  # noqa: B023, E731
            best = max(k for k in range(min(e, 6) + 1) if k == 0 or occurs(k))
            assert m == best and (m == 0 or b - a == occurs(m))
    assert len(FMIndex(np.zeros(0, np.uint64), np.zeros(0, np.int64)).alphabet) == 0


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(3)
    for top in (1, 2, 7, 300):
        symbols = rng.integers(0, top + 1, 500)
        matrix = WaveletMatrix(symbols, top)
        s, at = rng.integers(0, top + 1, 200), rng.integers(0, 501, 200)
        ranks = matrix.places(s, at) - matrix.places(s, np.zeros(200, np.int64))
        assert ranks.tolist() == [int((symbols[:a] == x).sum()) for x, a in zip(s, at, strict=True)]


def test_equal_windows_have_equal_anchors_and_segments_cover_all(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(R, "BLOCK", 37)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    start, size, anchor, _ = R.segments(words, 20, 8)
    of = {}
    for a, n, k in zip(start.tolist(), size.tolist(), anchor.tolist(), strict=True):
        for i in range(a, a + n - 19):
            assert i not in of
            of[i] = k
    assert sorted(of) == list(range(481))
    seen = {}
    for i, k in of.items():
        assert seen.setdefault(tuple(words[i : i + 20].tolist()), k) == k
    assert [len(x) for x in R.segments(words[:19], 20, 8)] == [0, 0, 0, 0]


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 5)))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 40, 70, 200)]
    loops = ["la"] * 150, ["la", "li"] * 60
    rows = []
    for n in range(160):
        words = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            some = list(rng.choice([*passages, *passages, *loops]))
            if rng.random() < 0.4:
                some[rng.randrange(len(some))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = some[rng.randrange(3) :]
        rows.append((rng.choice([n, n, n, None, 5]), "".join(w + rng.choice(["  ", " ", "\n", "\t", "\x0b", "\r\n"]) for w in words)))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (901, rows[3][1]), (902, None), (903, ""), (904, " \n"), (905, "one"), (906, "a\xa0b \x1c c"), (-3, rows[8][1]), (907, "again and " * 20_000), (908, "x " * 5000)]
    return rows


def write(spark, rows, at, kind="long"):
    docs = [(i, t, 1, "s", 2) for i, t in rows]
    spark.createDataFrame(docs, f"doc_id {kind}, text string, row int, start string, places int").coalesce(1).write.parquet(f"{at}/documents.parquet")


@pytest.mark.parametrize("hot,several,shard,block,places", [(1000, 4096, 1 << 20, 1 << 19, 100_000), (50, 2, 200, 64, 0), (2, 0, 50, 1 << 19, 100_000), (1 << 40, 3, 1 << 20, 1 << 19, 0)])
def test_query_is_the_brute_force_whatever_the_bounds(spark, tmp_path, monkeypatch, hot, several, shard, block, places):
    for name, value in (("HOT", hot), ("SEGMENTS", several), ("SHARD_WORDS", shard), ("BLOCK", block), ("BROADCAST_PLACES", places)):
        monkeypatch.setattr(R, name, value)
    rows = corpus()
    write(spark, rows, tmp_path)
    expected = by_hand(rows)
    assert sum(r[2] for r in expected) > 2000
    assert found(spark, tmp_path) == expected


def test_other_id_types_and_empty_tables(spark, tmp_path):
    rows = [("b", "w " * 50), ("a", "w " * 50), (None, "w " * 19), ("c", " ".join(map(str, range(40))))]
    write(spark, rows, tmp_path / "a", "string")
    assert found(spark, tmp_path / "a") == by_hand([(i, t) for i, t in rows])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert found(spark, tmp_path / "b") == []


def test_other_windows(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "x b c d e y"), (3, "e f g"), (4, "b c d")]
    write(spark, rows, tmp_path)
    kept = R.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"), 3, 2)
    assert {r["doc_id"]: r["kept"] for r in kept.collect()} == {1: "a b c d e f g", 2: "x y", 3: "", 4: ""}


def test_sql_says_the_same(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    expected = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({R.OP12_SQL})").fetchall(), key=repr)
    assert found(spark, at) == expected and sum(r[2] for r in expected) > 0

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerlume.llm import collocations as C
from ledgerlume.llm import filters, spans
from ledgerlume.llm.filters import Filter


def plain_words(text):
    """(word, broken) of a text by regular expressions."""
    out = []
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        out += [(w, i == 0) for i, w in enumerate(re.findall(r"[^\x20\x09]+", piece))]
    return out


@pytest.mark.parametrize("part", [1, 7, 40, 1 << 17])
def test_words_and_breaks_are_those_of_the_patterns(part, monkeypatch):
    monkeypatch.setattr(spans, "PART", part)
    rng = random.Random(part)
    texts = [None, "", ".", " . , ", "A b", "ÉA ß x\x1cy", "one two. three"] + ["".join(rng.choices("aB é \t.,\n", k=rng.randrange(30))) for _ in range(400)]
    found = defaultdict(list)
    for words in spans.Splitter(C.SEPARATORS, C.BREAKS, lower=True)(texts):
        for i, (text, broken) in enumerate(zip(words.text.tolist(), words.broken.tolist(), strict=True)):
            found[text].append((words.spelled(i).decode(), broken))
    for n, text in enumerate(texts):
        assert found[n] == plain_words(text), text


def test_equal_words_have_equal_hashes_and_others_do_not(monkeypatch):
    words = [f"w{n}" for n in range(5000)] + ["é" * n for n in range(1, 40)]
    seen = {}
    for part in (64, 1 << 17):
        monkeypatch.setattr(spans, "PART", part)
        for found in spans.Splitter(b" ")([" ".join(words)]):
            for i, h in enumerate(found.hash.tolist()):
                assert seen.setdefault(found.spelled(i), h) == h
    assert len(set(seen.values())) == len(seen) == len(words)
    one, two = (next(spans.Splitter(b" ", seed=s)(["word"])).hash[0] for s in (0, 1))
    assert one != two


@pytest.mark.parametrize("n,bits,split", [(2, 1, 0), (2, 9, 3), (3, 17, 6), (3, 21, 0), (3, 22, 5), (2, 40, 8), (3, 64, 0), (3, 64, 7), (2, 32, 4)])
def test_filters_lose_nothing(n, bits, split):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << min(bits, 6), 4000).astype(np.uint64) << np.uint64(max(0, bits - 8)) for _ in range(n)]
    assert all((a == b).all() for a, b in zip(filters.restore(filters.permute(ids, bits), bits), ids, strict=True))
    truth = Counter(zip(*(x.tolist() for x in ids), strict=True))
    whole = Filter.of(ids, bits, split)
    assert dict(zip(zip(*(x.tolist() for x in whole.ngrams()), strict=True), whole.count.tolist(), strict=True)) == truth
    assert whole.counts_of(ids).tolist() == [truth[t] for t in zip(*(x.tolist() for x in ids), strict=True)]
    halves = [Filter.of([x[a:b] for x in ids], bits, split) for a, b in ((0, 1500), (1500, 4000))]
    parts = defaultdict(list)
    for half in halves:
        for shard, part in half.parted():
            parts[shard].append(Filter.load(part.dump(), shard))
    assert len(parts) > 1 or not split
    merged = [found[0].merged(found[1:]) for found in parts.values()]
    assert {t: c for f in merged for t, c in zip(zip(*(x.tolist() for x in f.ngrams()), strict=True), f.count.tolist(), strict=True)} == truth


def test_large_counts_are_kept_and_blocks_are_compact():
    one = Filter.of([np.zeros(70_000, np.uint64), np.repeat(np.arange(2, dtype=np.uint64), 35_000)], 18)
    assert sorted(Filter.load(one.dump(), 0).count.tolist()) == [35_000, 35_000]
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 1 << 18, 200_000).astype(np.uint64) for _ in range(3)]
    assert len(Filter.of(ids, 18).dump()) < 7 * 200_000  # of 54 bits and a count


def by_hand(rows, least=10, top=2000):
    counts, out = defaultdict(Counter), []
    for lang, text in rows:
        words = plain_words(text)
        for i in range(len(words)):
            for k in (1, 2, 3):
                if i + k <= len(words) and not any(b for _, b in words[i + 1 : i + k]):
                    counts[lang or "und"][tuple(w for w, _ in words[i : i + k])] += 1
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def small_corpus():
    rng = random.Random(3)
    words = ["New", "york", "city", "the", "of", "é", "machine", "learning", "x-y", "ß"]
    rows = [(rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for w in rng.choices(words, [5, 5, 3, 9, 7, 2, 4, 4, 1, 1], k=rng.randrange(120)))) for _ in range(150)]
    return rows + [("en", "new york city " * 60), ("en", "new york city " * 60), ("und", "a b"), ("fr", None), (None, ""), ("es", " .. "), ("en", "again " * 30_000)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("words,held,per_part", [(1 << 20, 1 << 20, 1 << 20), (1 << 20, 40, 64), (0, 1 << 20, 1 << 20), (0, 40, 64)])
def test_query_is_the_brute_force_whatever_the_bounds(spark, tmp_path, monkeypatch, words, held, per_part):
    monkeypatch.setattr(C, "BROADCAST_WORDS", words)
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "PART_WORDS", per_part)
    rows = small_corpus()
    spark.createDataFrame([(None if i % 3 else i, t, l, 5, "z") for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, hash string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = C.op13_collocations(spark, str(tmp_path)).select(COLUMNS)
    assert dict(found.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in COLUMNS}
    assert sorted(map(tuple, found.collect())) == by_hand(rows)


def test_hashes_that_meet_are_replaced(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two " * 20)], "lang string, text string")
    real = C.word_counts

    def counted(frame, seed):
        found = real(frame, seed)
        return found.withColumn("hash", C.F.lit(0).cast("long")) if seed == 0 else found

    monkeypatch.setattr(C, "word_counts", counted)
    words, _, seed = C.known_words(docs, 10)
    assert seed == 1 and words.count() == 2


def test_small_tables_and_empty_ones(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.op13_collocations(spark, str(tmp_path)).count() == 0


def test_top_list_is_cut_by_rank(spark):
    rows = small_corpus()
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = C.top_phrases(C.candidates(docs, least=2), 5).select(COLUMNS)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, 2, 5)


def test_sql_says_the_same(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    expected = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({C.OP13_SQL})").fetchall()
    assert expected and sorted(map(tuple, C.op13_collocations(spark, at).select(COLUMNS).collect())) == sorted(expected)


def test_tables_between_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: every file starts processes that share an executor's memory for a moment."""
    written = []
    kept = C.materialise
    monkeypatch.setattr(C, "materialise", lambda frame, label, *bound: written.append(kept(frame, label, *bound)) or written[-1])
    values = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(200).selectExpr("CAST(id AS string) AS lang", "repeat(concat('a', id, ' b', id, ' '), 12) AS text")
        C.candidates(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) == 2 and all(0 < len(t.inputFiles()) <= 16 for t in written)

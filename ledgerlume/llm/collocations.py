"""Phrase collocations counted with quotient filters.

Words are counted first (a plain aggregation). Phrases that can matter have only words with LEAST occurrences or
more, so these words get dense ids per language and every other word ends a run. Tasks then count word-id n-grams of
two and three words in counting quotient filters (`filters.Filter`), which are parted by the first bits of
the permuted n-grams and sent as compact blocks; the filters of a part are merged where they meet. A part is a
hash range of a language's n-grams with about PART_WORDS occurrences, so a language or phrase with a third of all rows is
spread like any other: repeats are added up before they are sent.

The dictionary (8 bytes a frequent word) is broadcast while it has at most BROADCAST_WORDS words. Beyond that ids are
the words' 64-bit hashes: filters are wider and count rare words as well, results are the same. Two words of
a language with one hash are looked for among all words; then another hash is taken.

Scores are decimal: the products of counts may pass 64 bits.

Defined results: a null text is the empty text; a null lang is `und`; doc_id isn't looked at, so null ids and repeated
rows count as they are; texts without words and an empty table give no phrases; other columns pass by unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import Filter
from .joins import sized
from .spans import Splitter
from .storage import bounded_batches, materialise
from .words import U

SEPARATORS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Least occurrences of a phrase, share of them within a longer phrase that drops it (per cent), phrases of a language.
LEAST, INSIDE, TOP = 10, 50, 2000
#: Words of a dictionary that is broadcast; beyond it hashes are the ids.
BROADCAST_WORDS = 2_000_000
#: Occurrences in one part of a language's filters; entries that a task holds before it sends them.
PART_WORDS, HELD = 1 << 20, 1_500_000
#: Documents whose words, or phrases, are one file of an intermediate table.
DOCS = 1 << 14
#: Rows of a phrase table that may be broadcast.
BROADCAST_PHRASES = 200_000


def tongue() -> Column:
    return F.coalesce(F.col("lang"), F.lit("und")).alias("lang")


def by_language(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The languages of a batch (first column) and the place of each row's one among them."""
    coded = batch.column(0).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, hash, word, n of every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(SEPARATORS, BREAKS, lower=True, seed=seed)
        for batch in batches:
            langs, of = by_language(batch)
            for words in split(batch.column(1).to_pylist()):
                tongues = of[words.text]
                for code in np.unique(tongues):
                    own = np.flatnonzero(tongues == code)
                    hashes, first, n = np.unique(words.hash[own], return_index=True, return_counts=True)
                    spelled = [words.spelled(i).decode(errors="replace") for i in own[first]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[code]] * len(n), pa.string()), pa.array(hashes.view(np.int64)), pa.array(spelled, pa.string()), pa.array(n)],
                        names=["lang", "hash", "word", "n"],
                    )

    found = docs.select(tongue(), "text").mapInArrow(run, "lang string, hash long, word string, n long")
    return found.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def known_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """lang, hash, word, n of words with `least` occurrences; lang and all occurrences of its words; the seed of the hashes."""
    seed, n_docs = 0, docs.count()
    while True:
        every = materialise(word_counts(docs, seed), "words", n_docs, DOCS)
        shared = every.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most")).filter(f"words > 1 AND most >= {least}")
        if not shared.limit(1).count():
            return every.filter(F.col("n") >= least), every.groupBy("lang").agg(F.sum("n").alias("words")), seed
        seed += 1


class Dictionary:
    """Per language the sorted hashes of its frequent words, whose places are the ids; without one the hashes are the ids."""

    def __init__(self, hashes: dict[str, np.ndarray] | None):
        self.hashes = hashes

    def ids(self, lang: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and which of the words have one."""
        if self.hashes is None:
            return hashes, np.ones(len(hashes), bool)
        held = self.hashes.get(lang, np.zeros(0, U))
        if not len(held):
            return hashes, np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
        return at.astype(U), held[at] == hashes

    def bits(self, lang: str) -> int:
        return 64 if self.hashes is None else max(1, len(self.hashes[lang]).bit_length())

    def of(self, lang: str, ids: np.ndarray) -> np.ndarray:
        return ids if self.hashes is None else self.hashes[lang][ids.astype(np.int64)]


def dictionary(words: DataFrame) -> Dictionary:
    if words.count() > BROADCAST_WORDS:
        return Dictionary(None)
    table = words.select("lang", "hash").toArrow()
    langs, of = by_language(table.combine_chunks().to_batches()[0]) if table.num_rows else ([], np.zeros(0, np.int64))
    hashes = table.column("hash").to_numpy().view(U)
    return Dictionary({lang: np.sort(hashes[of == code]) for code, lang in enumerate(langs)})


def split_bits(words: int) -> int:
    """Bits that part a language's n-grams, by its occurrences of words."""
    return max(0, (words // PART_WORDS).bit_length())


def phrase_counts(docs: DataFrame, held: Dictionary, large: dict[str, int], seed: int, least: int) -> DataFrame:
    """lang, n, h1, h2, h3 (hashes of the words; h3 null for two), a: phrases of two and three words with `least` occurrences."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((held, {lang: split_bits(n) for lang, n in large.items()}))

    def blocks(kept: dict[tuple[str, int], list[Filter]]) -> Iterator[pa.RecordBatch]:
        for (lang, n), found in kept.items():
            rows = [(shard, part.dump()) for shard, part in found[0].merged(found[1:]).parted()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), pa.array([n] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["lang", "n", "part", "block"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, splits = shared.value
        split, kept, entries = Splitter(SEPARATORS, BREAKS, lower=True, seed=seed), {}, 0
        for batch in batches:
            langs, of = by_language(batch)
            runs: dict[int, list[tuple]] = {}
            for part in split(batch.column(1).to_pylist()):
                tongues = of[part.text]
                for code in np.unique(tongues):
                    own = slice(None) if tongues[0] == tongues[-1] == code and (tongues == code).all() else np.flatnonzero(tongues == code)
                    ids, known = words.ids(langs[code], part.hash[own])
                    runs.setdefault(int(code), []).append((ids, known, part.broken[own]))
            for code, found in runs.items():
                ids, known, broken = map(np.concatenate, zip(*found, strict=True))
                pair = np.flatnonzero(known[:-1] & known[1:] & ~broken[1:])
                three = pair[:-1][np.diff(pair) == 1]
                for n, at in ((2, pair), (3, three)):
                    if len(at):
                        lang = langs[code]
                        one = Filter.of([ids[at + i] for i in range(n)], words.bits(lang), splits.get(lang, 0))
                        kept.setdefault((lang, n), []).append(one)
                        entries += len(one.count)
            if entries > HELD:
                kept = {key: [found[0].merged(found[1:])] for key, found in kept.items()}
                entries = sum(len(found[0].count) for found in kept.values())
                if entries > HELD // 2:
                    yield from blocks(kept)
                    kept, entries = {}, 0
        yield from blocks(kept)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, found, entries = shared.value[0], None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if found:
                lang, n, _ = at
                kept = found[0].merged(found[1:]).at_least(least)
                hashes = [pa.array(words.of(lang, x).view(np.int64)) for x in kept.ngrams()]
                m = len(kept.count)
                hashes += [pa.nulls(m, pa.int64())] * (3 - n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([n] * m, pa.int32()), *hashes, pa.array(kept.count)], names=["lang", "n", "h1", "h2", "h3", "a"])

        for batch in batches:
            for lang, n, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, n, part) != at:
                    yield from close()
                    at, found, entries = (lang, n, part), [], 0
                found.append(Filter.load(block, part))
                entries += len(found[-1].count)
                if entries > HELD and len(found) > 1:
                    found = [found[0].merged(found[1:])]
                    entries = 0  # what is merged is held once, whatever comes
        yield from close()

    sent = docs.select(tongue(), "text").mapInArrow(count, "lang string, n int, part long, block binary")
    dealt = sent.repartition("lang", "n", "part").sortWithinPartitions("lang", "n", "part")
    return dealt.mapInArrow(merge, "lang string, n int, h1 long, h2 long, h3 long, a long")


def score() -> Column:
    """floor(1000000 a a / (l r)) in whole decimals."""
    return F.expr("CAST(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)")


def candidates(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that stay."""
    bounded_batches(docs.sparkSession)
    words, totals, seed = known_words(docs, least)
    n_words = words.count()
    large = {r["lang"]: r["words"] for r in totals.filter(F.col("words") >= PART_WORDS).collect()}  # at most a row for so many words
    phrases = materialise(phrase_counts(docs, dictionary(words), large, seed, least), "phrases", docs.count(), DOCS)
    twos = phrases.filter("n = 2").select("lang", "h1", "h2", "a")
    threes = phrases.filter("n = 3").select("lang", "h1", "h2", "h3", "a")
    n_twos = twos.count()

    def with_word(frame: DataFrame, place: int) -> DataFrame:
        one = words.select("lang", F.col("hash").alias(f"h{place}"), F.col("word").alias(f"w{place}"), F.col("n").alias(f"f{place}"))
        return frame.join(sized(one, n_words, BROADCAST_PHRASES), ["lang", f"h{place}"])

    def with_pair(frame: DataFrame, first: int) -> DataFrame:
        one = twos.select("lang", F.col("h1").alias(f"h{first}"), F.col("h2").alias(f"h{first + 1}"), F.col("a").alias(f"f{first}{first + 1}"))
        return frame.join(sized(one, n_twos, BROADCAST_PHRASES), ["lang", f"h{first}", f"h{first + 1}"])

    longer = threes.select("lang", "h1", "h2", F.col("a").alias("longer")).unionByName(threes.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("a").alias("longer")))
    longer = longer.groupBy("lang", "h1", "h2").agg(F.max("longer").alias("longer"))
    stay = twos.join(longer, ["lang", "h1", "h2"], "left").filter(f"longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) < CAST({int(inside)} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0))")
    two = with_word(with_word(stay, 1), 2).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    three = with_pair(with_pair(with_word(with_word(with_word(threes, 1), 2), 3), 1), 2)
    cuts = {"l": ("f1", "f12"), "r": ("f23", "f3")}
    for k in (0, 1):
        three = three.withColumn("l", F.col(cuts["l"][k])).withColumn("r", F.col(cuts["r"][k])).withColumn(f"cut{k}", F.struct(score().alias("score"), "l", "r")).drop("l", "r")
    lowest = F.when(F.col("cut1.score") < F.col("cut0.score"), F.col("cut1")).otherwise(F.col("cut0"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r")
    return two.unionByName(three).withColumn("score", score()).join(sized(totals.withColumnRenamed("words", "n"), totals.count(), BROADCAST_PHRASES), "lang")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of every language; tasks drop what can't be among them before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2000 phrases of every language."""
    return top_phrases(candidates(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, row_number() OVER () AS run, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, run, unnest(w) AS w1, unnest(range(len(w))) AS i FROM runs
), grams AS (
  SELECT lang, w1, lead(w1) OVER here AS w2, lead(w1, 2) OVER here AS w3 FROM places WINDOW here AS (PARTITION BY run ORDER BY i)
), ones AS MATERIALIZED (
  SELECT lang, w1, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, w1
), twos AS MATERIALIZED (
  SELECT lang, w1, w2, CAST(count(*) AS BIGINT) AS a FROM grams WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
), threes AS MATERIALIZED (
  SELECT lang, w1, w2, w3, CAST(count(*) AS BIGINT) AS a FROM grams WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(a) AS most
  FROM (SELECT lang, w1, w2, a FROM threes UNION ALL SELECT lang, w2, w3, a FROM threes) GROUP BY lang, w1, w2
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS cut, c.a, x.a AS l, y.a AS r
  FROM twos c JOIN ones x ON x.lang = c.lang AND x.w1 = c.w1 JOIN ones y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN longer g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2
  WHERE g.most IS NULL OR 100 * g.most < 50 * c.a
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.a, x.a, y.a
  FROM threes c JOIN ones x ON x.lang = c.lang AND x.w1 = c.w1 JOIN twos y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.a, x.a, y.a
  FROM threes c JOIN twos x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN ones y ON y.lang = c.lang AND y.w1 = c.w3
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM ones GROUP BY lang
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest c JOIN totals t ON t.lang = c.lang QUALIFY rank <= 2000
"""

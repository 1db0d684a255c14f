"""Removal of word passages that occur earlier, by FM-indexes of shards.

A window is WINDOW consecutive words of a document. Of equal windows the first one stays (smallest doc_id, then row,
then start), and every word that a later one covers goes.

Routing: the least hash among a window's SEED-word sequences is its anchor, so equal windows have equal anchors, and
neighbouring windows mostly share one. A run of windows with one anchor is a segment of some 26 words; a seventh as many
segments as words are dealt by their anchors. Equal segments are found by digest there: all but the first go as a whole.
Where an anchor has several different segments, their words are fetched and go to the shard of the anchor: the shard's
FM-index holds its segments, and the segments are streamed against it; backward search gives the matching statistics of
every window, and windows that match over their whole length in two places or more are told apart by their suffix
interval, whose first place in the order stays.

Hot anchors (over 1 / HOT of all segments, so fewer than HOT) are aggregated before they are dealt. An anchor with over
SEGMENTS different segments doesn't go to one shard: its windows are compared one by one, by digest, in the same two ways.

Defined results: a null text has no words; a null doc_id comes before all others; rows with one doc_id are documents
of their own, in the order of their files and rows; repeated rows lose their windows to the first of them; texts of
fewer words than a window lose nothing; an empty table gives an empty result; whole texts are read at any length;
other columns pass by unseen. Equal means equal 64-bit hashes of all words within equal anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .joins import HOT, by_key, sized
from .spans import Splitter
from .storage import bounded_batches, fresh_path, materialise, release, scratch
from .words import BASE, INVERSE, U, mix, powers

WINDOW, SEED = 20, 8
SPACE = b" \t\n\x0b\x0c\r"
#: Words in the index of one shard, different segments of an anchor in one shard, words that one step works on.
SHARD_WORDS, SEGMENTS, BLOCK = 1 << 20, 4096, 1 << 19
#: Rows of places (about 100 bytes each once hashed) up to which they are broadcast to the texts.
BROADCAST_PLACES = 100_000


def sequence_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of sequences of words."""
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(len(words), BASE, "powers")[:-1], out=total[1:])
    return mix((total[start + size] - total[start]) * powers(len(words), INVERSE, "inverses")[start] + size.astype(U))


def segments(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size in words, anchor and digest of the segments of one text."""
    found = []
    for at in range(0, max(0, len(words) - window + 1), BLOCK):
        block = words[at : at + BLOCK + window - 1]
        places = np.arange(len(block) - seed + 1)
        seeds = mix(sequence_hashes(block, places, np.full(len(places), seed)) ^ U(BASE))
        least = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1).argmin(1)
        least += np.arange(len(least))
        start = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        size = np.diff(start, append=len(least)) + window - 1
        found.append((start + at, size, seeds[least[start]], sequence_hashes(block, start, size)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of every text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for words in Splitter(SPACE)(texts):
        edge = np.flatnonzero(np.diff(words.text)) + 1
        for a, b in zip([0, *edge], [*edge, len(words.text)], strict=True):
            if b > a:
                found[words.text[a]].append(words.hash[a:b])
    return [np.concatenate([np.zeros(0, U), *x]) for x in found]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: rows of a table that is read from files, numbered by file and place, alike at every read."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    files = materialise(rows.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file"))), "files")  # a row per file
    return rows.join(sized(files, files.count(), BROADCAST_PLACES), "__file").select((F.col("__number") * F.lit(1 << 36) + F.col("__place")).alias("row"), "doc_id", "text")


def all_segments(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, row, start, size, anchor, digest of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(w, window, seed) for w in hashed(batch.column(2).to_pylist())]
            owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            if len(owner):
                columns = [as_long(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner)), batch.column(0).take(pa.array(owner)), *columns], names=["doc_id", "row", "start", "size", "anchor", "digest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, start long, size long, anchor long, digest long")


PLACE = ["doc_id", "row", "start"]


def told_apart(dealt: DataFrame, hot: DataFrame, n_rows: int) -> DataFrame:
    """Places with `gone` (an equal segment stands earlier) or `mixed` (the first of its segment, whose anchor has others).

    `dealt` has anchor, digest and the place; the anchors of `hot` are few and are aggregated before the shuffle.
    """
    hot = materialise(hot, "hot-anchors")
    marked = dealt.join(F.broadcast(hot.select("anchor", F.lit(True).alias("__hot"))), "anchor", "left")
    columns = [*PLACE, "size", "anchor", "digest"]
    cold = marked.filter("__hot IS NULL").repartition("anchor")
    same = Window.partitionBy("anchor", "digest").orderBy(*PLACE)
    cold = cold.select(*columns, (F.row_number().over(same) > 1).alias("gone"))
    cold = cold.select(*columns, "gone", (F.min("digest").over(Window.partitionBy("anchor")) < F.max("digest").over(Window.partitionBy("anchor"))).alias("differs"))
    cold = cold.select(*columns, "gone", (~F.col("gone") & F.col("differs")).alias("mixed")).filter("gone OR mixed")
    if not hot.limit(1).count():
        return cold

    warm = marked.filter("__hot").select(*columns).withColumn("segment", F.struct("anchor", "digest"))
    groups = materialise(warm.groupBy("segment").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("copies")), "hot-segments")
    several = groups.groupBy("segment.anchor").agg((F.count(F.lit(1)) > 1).alias("differs"))
    joined = by_key(warm, groups, "segment", "copies", n_rows).join(F.broadcast(several), "anchor")
    gone = ~(F.struct("row", "start") == F.struct("first.row", "first.start"))
    warm = joined.select(*columns, gone.alias("gone"), (~gone & F.col("differs")).alias("mixed")).filter("gone OR mixed")
    return cold.unionByName(warm)


def hot_keys(dealt: DataFrame) -> tuple[DataFrame, int]:
    """Anchors with over 1 / HOT of the rows, and the number of rows."""
    counts = materialise(dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * HOT > total).select("anchor"), total


def listed(grouped: DataFrame, name: str) -> int:
    """Elements of all arrays of a table: they, not its rows, make its size."""
    return grouped.agg(F.sum(F.size(name))).first()[0] or 0


def at_places(rows: DataFrame, places: DataFrame, *names: str) -> DataFrame:
    """row, doc_id, text and an array of structs (`names`) for the rows that have places."""
    grouped = places.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("places"))
    grouped = materialise(grouped, "places")
    return rows.join(sized(grouped, listed(grouped, "places"), BROADCAST_PLACES), "row")


def cut_out(rows: DataFrame, window: int) -> DataFrame:
    """The words of segments that go to a `shard`; of the others each window, with its digest."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(hashed(batch.column(2).to_pylist())):
                listed = batch.column(3)[i].values.flatten()
                start, size, anchor = (listed[k].to_numpy() for k in range(3))
                sharded = listed[3].is_valid().to_numpy(zero_copy_only=False)
                one, other = np.flatnonzero(sharded), np.flatnonzero(~sharded)
                n = size[other] - window + 1
                at = np.repeat(start[other] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                lengths = np.concatenate([[0], size[one], np.zeros(len(at), np.int64)])
                held = [words[x : x + y] for x, y in zip(start[one], size[one], strict=True)]
                m = len(one) + len(at)
                columns = [
                    as_long(np.concatenate([start[one], at])), as_long(np.concatenate([size[one], np.full(len(at), window)])), as_long(np.concatenate([anchor[one], np.repeat(anchor[other], n)])),
                    as_long(np.concatenate([np.zeros(len(one), U), sequence_hashes(words, at, np.full(len(at), window))])),
                    pa.concat_arrays([listed[3].take(pa.array(one)), pa.nulls(len(at), pa.int64())]), pa.ListArray.from_arrays(np.cumsum(lengths).astype(np.int32), as_long(np.concatenate([np.zeros(0, U), *held]))),
                ]
                owner = pa.array(np.full(m, i))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(owner), batch.column(0).take(owner), *columns], names=["doc_id", "row", "start", "size", "anchor", "digest", "shard", "words"])

    rows = rows.select("row", "doc_id", "text", "places")
    return rows.mapInArrow(run, f"doc_id {kind}, row long, start long, size long, anchor long, digest long, shard long, words array<long>")


def later_windows(words: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Where in `words` windows begin that stand earlier too, in the order of the sequences."""
    index = FMIndex(words, sizes)
    stop = np.cumsum(sizes)
    n = np.maximum(0, sizes - window + 1)
    start = np.repeat(stop - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
    matched, low, _ = index.matches(words, start + window, window, least=2)
    whole = np.flatnonzero(matched == window)
    _, first = np.unique(low[whole], return_index=True)  # windows stand in order, so the first of an interval is the earliest
    return start[np.delete(whole, first)]


def repeated_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """row, start, size of the windows that stand earlier in another piece of their shard."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            sizes = np.array([len(w) for _, _, w in held])
            later = later_windows(np.concatenate([w for _, _, w in held]).view(U), sizes, window)
            piece = np.searchsorted(np.cumsum(sizes), later, side="right")
            row, start = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            begin = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(row[piece]), pa.array(start[piece] + later - begin[piece]), pa.array(np.full(len(later), window, np.int64))], names=["row", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            words, stop = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for i, (shard, row, start) in enumerate(zip(*(batch.column(k).to_numpy().tolist() for k in range(3)), strict=True)):
                if shard != at:
                    yield from close(held)
                    at, held = shard, []
                held.append((row, start, words[stop[i] : stop[i + 1]].copy()))
        yield from close(held)

    dealt = pieces.repartition("shard").sortWithinPartitions("shard", *PLACE)
    return dealt.select("shard", "row", "start", "words").mapInArrow(run, "row long, start long, size long")


def repeated_spans(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row, start, size (in words) of passages that stand earlier; spans may overlap."""
    spark = rows.sparkSession
    path = fresh_path(spark, "segments")
    with scratch(spark):
        dealt = materialise(all_segments(rows, window, seed), "all-segments")
        told = told_apart(dealt, *hot_keys(dealt))
        told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    mixed = told.filter("mixed")
    size = mixed.agg(F.sum("size")).first()[0] or 0
    wide = mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SEGMENTS).select("anchor", F.lit(True).alias("wide"))
    wide = materialise(wide, "wide-anchors")
    shard = F.when(F.col("wide").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(size // SHARD_WORDS + 1)))
    places = mixed.join(sized(wide, wide.count(), BROADCAST_PLACES), "anchor", "left").select("row", "start", "size", "anchor", shard.alias("shard"))
    cut = materialise(cut_out(at_places(rows, places, "start", "size", "anchor", "shard"), window), "cut")
    release(spark)
    spans = told.filter("gone").select("row", "start", "size").unionByName(repeated_pieces(cut.filter("shard IS NOT NULL"), window))
    if wide.limit(1).count():
        windows = cut.filter("shard IS NULL").drop("shard", "words").withColumn("anchor", F.xxhash64("anchor", "digest"))
        spans = spans.unionByName(told_apart(windows, *hot_keys(windows)).filter("gone").select("row", "start", "size"))
    return spans


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) of every row of a table that is read from files; others are written first by the caller."""
    bounded_batches(docs.sparkSession)
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "spans")
    with scratch(spark):
        spans = repeated_spans(numbered(docs), window, seed).groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
        spans.write.parquet(path)
    spans = spark.read.schema(spans.schema).parquet(path)
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if found.is_valid:
                    start, size = (found.values.field(k).to_numpy() for k in (0, 1))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + size, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                out.append((n, n - len(words), b" ".join(words).decode()))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(sized(spans, listed(spans, "spans"), BROADCAST_PLACES), "row", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, row, unnest(w) AS word, unnest(range(len(w))) AS i FROM split
), windows AS (
  SELECT doc_id, row, i, list(word) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM words
), judged AS (
  SELECT row, i, row_number() OVER (PARTITION BY md5(array_to_string(seq, ' ')) ORDER BY doc_id, row, i) > 1 AS again FROM windows WHERE len(seq) = 20
), marked AS (
  SELECT w.row, w.i, w.word, coalesce(bool_or(j.again) OVER (PARTITION BY w.row ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN judged j ON j.row = w.row AND j.i = w.i
), kept AS (
  SELECT row, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY row
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.row = s.row
"""

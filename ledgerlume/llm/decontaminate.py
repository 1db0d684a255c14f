"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

1. Words of all documents become 32-bit hashes, written once as a token table, in segments of SEGMENT
   words that overlap by the room of the longest item, so that a long text is many rows.
2. TF-IDF over passages of WINDOW words, hashed into FEATURES; document frequencies cover all passages.
3. A randomised SVD of the passages: Spark sums the product of A'A with an orthonormal Gaussian test matrix Q
   over all of them, and its Nystroem approximation gives the singular vectors. The benchmark's passages are
   rows of A too, weighed so that they have BENCHMARK_SHARE times the documents' sum of squares between
   them, whatever their number. The space is FEATURES x RANK for any corpus and one for all items.
4. Windows at every BLOCK words are projected and compared with the benchmark's passages by cosine in
   that space; LEAST_COSINE, and LEAST_SHARE of the benchmark passage's projected length within the
   window's whole length, make a candidate.
5. Candidates are verified on whole items: the longest common subsequence of words between the item and
   the text around the window. COPY of the item's words in order is a copy. A paraphrase has PARAPHRASE
   of them and, as its answer check, ANSWER_SHARE of the answer's words in order. The answer is the
   column `answer` if the benchmark has one, else the item's last ANSWER_WORDS words.

Items are searched for in blocks of ITEM_BLOCK, each broadcast by itself, so any number is handled; blocks
share the space, so they don't change what is found. Items of fewer than LEAST_ITEM words are found as
exact runs of words instead.

Defined results: a null or empty text or item matches nothing; case and the kind of white space don't
matter; whole texts are searched; several matches of a document and item give one row, the first best;
`at` is the word where the best window lets the item begin, give or take a window; rows that repeat an
id (null among them) are one document; `keep_clean` decides by row, not by id; repeated items count once;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .joins import row_key, without_rows
from .storage import bounded_batches, materialise
from .words import word_hashes
from .workers import claim

FEATURES, RANK, EXTRA, SEED = 1 << 15, 64, 8, 17
BLOCK, WINDOW, SHORT_WINDOW = 8, 32, 16
BENCHMARK_SHARE = 300.0
LEAST_COSINE, LEAST_SHARE = 0.45, 0.3
COPY, PARAPHRASE, ANSWER_WORDS, ANSWER_SHARE = 0.8, 0.6, 6, 0.8
LEAST_ITEM, ITEM_BLOCK = 8, 4096
#: Words of a segment without its overlap: whole windows.
SEGMENT = 1 << 15
#: Words that one step of a task works on at once, of a product, and features in one row of a sum.
PART, STEP, CHUNK = 1 << 16, 1 << 10, 512


def room(size: int) -> int:
    """Words around a window's guess in which an item of `size` words is verified, on either side."""
    return 2 * BLOCK + size // 4


def token_table(docs: DataFrame, overlap: int) -> DataFrame:
    """doc_id, offset, words (32-bit hashes as bytes): the segments of every row that has words; doc_id may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        for batch in batches:
            of, offsets, words = [], [], []
            for n, w in enumerate(word_hashes(batch.column(1).to_pylist())):
                for at in range(0, len(w), SEGMENT):
                    of.append(n)
                    offsets.append(at)
                    words.append(w[at : at + SEGMENT + overlap].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(offsets, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "offset", "words"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, offset long, words binary")


def padded_parts(batches: Iterator[pa.RecordBatch], unit: int, at_least: int = 1, most: int | None = None) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids with offsets, words, features, starts, lengths): segments padded to whole units, about PART words at a time.

    `starts` counts units, lengths count words; padding has the feature FEATURES. Of a segment the first `most` words count.
    """
    ids, parts, size = [], [], 0

    def joined():
        length = np.array([len(p) for p in parts])
        blocks = np.maximum(-(-length // unit), at_least)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        words, features = np.zeros(starts[-1] * unit, np.uint32), np.full(starts[-1] * unit, FEATURES, np.int32)
        place = np.arange(length.sum()) + np.repeat(starts[:-1] * unit - (np.cumsum(length) - length), length)
        words[place] = np.concatenate(parts)
        features[place] = (words[place] % np.uint32(FEATURES)).astype(np.int32)
        return ids, words, features, starts, length

    for batch in batches:
        for doc, offset, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids.append((doc, offset))
            parts.append(np.frombuffer(raw.as_buffer(), np.uint32)[:most])
            size += len(parts[-1])
            if size >= PART:
                yield joined()
                ids, parts, size = [], [], 0
    if ids:
        yield joined()


def passage_counts(tokens: DataFrame) -> np.ndarray:
    """Passages that hold each feature; the number of passages comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(FEATURES + 1, np.int64)
        for _, _, features, _, _ in padded_parts(batches, WINDOW, most=SEGMENT):
            rows = np.sort(features.reshape(-1, WINDOW), axis=1)
            new = np.ones(rows.shape, bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            n[:FEATURES] += np.bincount(rows[new], minlength=FEATURES + 1)[:FEATURES]
            n[FEATURES] += len(rows)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in tokens.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r.feature] = r.n  # at most FEATURES + 1 rows
    return out


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """TF-IDF weight of each feature; padding has none."""
    idf = np.log((counts[-1] + 1.0) / (counts + 1.0)).astype(np.float32)
    idf[FEATURES] = 0
    return idf


def passages(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and weights of passages, each of length one, a row a passage."""
    for _, _, features, _, _ in padded_parts(batches, WINDOW, most=SEGMENT):
        f = features.reshape(-1, WINDOW)
        v = idf[f]
        yield f, v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)


def summed(tokens: DataFrame, part, shared) -> np.ndarray:
    """FEATURES + 1 x RANK + EXTRA: the sum of `part(batches, shared value)` over all tasks, in chunks of features."""
    width = RANK + EXTRA
    told = tokens.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        total = part(batches, told.value).astype(np.float32)
        chunks = [(i, total[i : i + CHUNK]) for i in range(0, FEATURES, CHUNK)]
        chunks = [(i, c.tobytes()) for i, c in chunks if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.binary())], names=["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = sums.setdefault(i, np.zeros(CHUNK * width))
                into += np.frombuffer(raw.as_buffer(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "part"])

    out = np.zeros((FEATURES + 1, width), np.float32)
    parts = tokens.mapInArrow(run, "chunk int, part binary")
    for r in parts.repartition("chunk").mapInArrow(add, "chunk int, part binary").collect():  # FEATURES x (RANK + EXTRA) numbers in all
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.part, np.float32).reshape(CHUNK, width)
    return out


def covariance_product(batches: Iterator[pa.RecordBatch], shared: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A'(AQ), some passages at a time as a matrix over the features that they hold."""
    idf, basis = shared
    total = np.zeros(basis.shape, np.float32)
    for features, values in passages(batches, idf):
        for low in range(0, len(features), STEP // WINDOW):
            f, v = features[low : low + STEP // WINDOW], values[low : low + STEP // WINDOW]
            known, column = np.unique(f, return_inverse=True)
            at = np.arange(len(f))[:, None] * len(known) + column.reshape(f.shape)
            rows = np.bincount(at.ravel(), weights=v.ravel(), minlength=len(f) * len(known)).reshape(len(f), -1).astype(np.float32)
            total[known] += rows.T @ (rows @ basis[known])
    return total


def latent_space(tokens: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """idf, and the FEATURES + 1 x RANK first right singular vectors of the passages of both token tables."""
    counts, own = passage_counts(tokens), passage_counts(items)
    idf = inverse_frequency(counts)
    weight = BENCHMARK_SHARE * max(1, counts[-1]) / max(1, own[-1])  # of a benchmark passage's square
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((FEATURES + 1, RANK + EXTRA)).astype(np.float32))[0]
    product = summed(tokens, covariance_product, (idf, basis))
    product += np.float32(weight) * summed(items, covariance_product, (idf, basis))
    return idf, singular_vectors(basis, product)


def orthonormal(x: np.ndarray, rank: int | None = None) -> np.ndarray:
    """An orthonormal basis of the columns' space, in the order of their weight, by the small Gram matrix."""
    squares, turn = np.linalg.eigh((x.T @ x).astype(float))
    best = np.argsort(-squares)[:rank]
    best = best[squares[best] > 1e-6 * max(squares.max(initial=0), 1e-12)]
    return x @ (turn[:, best] / np.sqrt(squares[best])).astype(np.float32)


def singular_vectors(basis: np.ndarray, product: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Singular vectors of A from Q and A'AQ, by the Nystroem approximation A'AQ (Q'A'AQ)^-1 (A'AQ)'."""
    core = (basis.T @ product).astype(float)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-6 * max(values.max(initial=0), 1e-12)
    out = orthonormal(product @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32), rank)
    out[FEATURES] = 0
    return out


class Item:
    """A benchmark item as verified against texts."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray):
        self.item_id, self.words, self.answer = item_id, words, answer

    @staticmethod
    def bits(words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            out[w] = out.get(w, 0) | 1 << i
        return out


def common_subsequence(bits: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    row, full = (1 << size) - 1, (1 << size) - 1
    for w in text:
        hit = row & bits.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Index:
    """A block of benchmark items in latent space."""

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray):
        self.short = [i for i in items if len(i.words) < LEAST_ITEM]
        self.items = [i for i in items if len(i.words) >= LEAST_ITEM]
        self.bits = [Item.bits(i.words) for i in self.items]
        self.answer_bits = [Item.bits(i.answer) for i in self.items]
        self.chunks: dict[int, list[tuple[int, int]]] = {SHORT_WINDOW: [], WINDOW: []}  # width: (item, offset)
        for n, item in enumerate(self.items):
            size = len(item.words)
            width = SHORT_WINDOW if size <= SHORT_WINDOW else WINDOW
            last = max(0, size - width)
            self.chunks[width] += [(n, s) for s in sorted({*range(0, last, width // 2), last})]
        self.weighted = np.ascontiguousarray(basis * idf[:, None])
        self.squares = idf**2
        self.length, self.latent = {}, {}
        for w, chunks in self.chunks.items():
            part = np.zeros((len(chunks), basis.shape[1]), np.float32)
            for r, (n, s) in enumerate(chunks):
                f = (self.items[n].words[s : s + w] % np.uint32(FEATURES)).astype(np.int64)
                seen, times = np.unique(f, return_counts=True)
                part[r] = self.weighted[f].sum(0) / np.maximum(np.sqrt((self.squares[seen] * times * times).sum()), 1e-9)
            self.length[w] = np.maximum(np.linalg.norm(part, axis=1), 1e-9)
            self.latent[w] = (part / self.length[w][:, None]).T.copy()

    def projected(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each block's words in latent space, and of their squares."""
        blocks = np.empty((len(features) // BLOCK, self.weighted.shape[1]), np.float32)
        for low in range(0, len(blocks), STEP // BLOCK):
            f = features[low * BLOCK : low * BLOCK + STEP]
            blocks[low : low + STEP // BLOCK] = self.weighted[f].reshape(-1, BLOCK, self.weighted.shape[1]).sum(1)
        return blocks, self.squares[features].reshape(-1, BLOCK).sum(1)

    def candidates(self, features: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(segment, item, first word of the item as the window suggests it, cosine)."""
        blocks, squares = self.projected(features)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for width, chunks in self.chunks.items():
            n = width // BLOCK
            if not chunks or len(blocks) < n:
                continue
            top = len(blocks) - n + 1
            sums, lengths = blocks[:top].copy(), squares[:top].copy()
            for i in range(1, n):
                sums += blocks[i : i + top]
                lengths += squares[i : i + top]
            size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            share = size / np.sqrt(np.maximum(lengths, 1e-9))
            # a cosine is at most 1: a window with less of its length in the space can't reach LEAST_SHARE
            at = np.flatnonzero((owner[:top] == owner[n - 1 :]) & (share >= LEAST_SHARE * self.length[width].min()) & (size > 0))
            step = max(1, (1 << 22) // len(chunks))
            for low in range(0, len(at), step):
                some = at[low : low + step]
                cosine = (sums[some] / size[some][:, None]) @ self.latent[width]
                r, c = np.nonzero(cosine >= LEAST_COSINE)
                good = cosine[r, c] * share[some[r]] >= LEAST_SHARE * self.length[width][c]
                for w, k in zip(r[good].tolist(), c[good].tolist(), strict=True):
                    item, offset = chunks[k]
                    doc = int(owner[some[w]])
                    yield doc, item, (int(some[w]) - int(starts[doc])) * BLOCK - offset, float(cosine[w, k])

    def verify(self, item: int, text: np.ndarray, at: int) -> tuple[float, float]:
        """Shares of the item's and of the answer's words that stand in order around word `at` of a text."""
        words, answer = self.items[item].words, self.items[item].answer
        slack = room(len(words))
        near = text[max(0, at - slack) : max(0, at + len(words) + slack)].tolist()
        if sum(map(self.bits[item].__contains__, near)) < PARAPHRASE * len(words):  # a subsequence takes a word of the text for each of its own
            return 0.0, 0.0
        share = common_subsequence(self.bits[item], len(words), near) / len(words)
        if share < PARAPHRASE or not len(answer):
            return share, 0.0
        return share, common_subsequence(self.answer_bits[item], len(answer), near) / len(answer)

    def runs(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item id, first word) of short items that stand in a text word for word."""
        for item in self.short:
            n = len(item.words)
            if n and len(text) >= n:
                hit = np.ones(len(text) - n + 1, bool)
                for i in range(n):
                    hit &= text[i : i + len(hit)] == item.words[i]
                if hit.any():
                    yield item.item_id, int(hit.argmax())


def match_schema(tokens: DataFrame) -> str:
    return f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, lcs double, answer double, at long"


def search(tokens: DataFrame, index: Index) -> DataFrame:
    """Verified matches of one block of items."""
    shared = tokens.sparkSession.sparkContext.broadcast(index)
    id_kind = to_arrow_type(tokens.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        ix = shared.value
        for ids, words, features, starts, length in padded_parts(batches, BLOCK, WINDOW // BLOCK):
            text = lambda d: words[starts[d] * BLOCK : starts[d] * BLOCK + length[d]]  # noqa: B023, E731
            found: dict[tuple[int, int], tuple] = {}
            tried = set()
            for doc, item, at, cosine in ix.candidates(features, starts):
                if (doc, item, at) in tried:
                    continue
                tried.add((doc, item, at))
                share, answer = ix.verify(item, text(doc), at)
                if share >= COPY or (share >= PARAPHRASE and answer >= ANSWER_SHARE):
                    key = (doc, ix.items[item].item_id)
                    best = found.get(key)
                    if best is None or (share, cosine, -at) > (best[1], best[0], -best[3]):
                        found[key] = (cosine, share, answer, at)
            for doc in range(len(ids)) if ix.short else ():
                for item_id, at in ix.runs(text(doc)):
                    found[doc, item_id] = (1.0, 1.0, 1.0, at)
            rows = [(ids[d][0], i, cosine, share, answer, at + ids[d][1]) for (d, i), (cosine, share, answer, at) in found.items()]
            kinds = [id_kind, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer", "at"])

    return tokens.mapInArrow(run, match_schema(tokens))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, answer of every distinct item with an id and a text."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    return items.filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, at of every contaminated document and item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = materialise(benchmark_items(benchmark), "benchmark", benchmark.count())
    own = materialise(token_table(items.select(F.col("item_id").alias("doc_id"), "text"), 0), "benchmark-tokens")
    longest = own.agg(F.max(F.col("offset") + F.octet_length("words") / 4)).first()[0]
    if longest is None:
        return spark.createDataFrame([], match_schema(docs))
    tokens = materialise(token_table(docs, int(longest) + 2 * room(int(longest)) + WINDOW), "tokens")
    idf, basis = latent_space(tokens, own)
    blocks = -(-items.count() // ITEM_BLOCK)
    found = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about ITEM_BLOCK rows
        words, answers = ([w.astype(np.uint32) for w in word_hashes([r[name] for r in rows])] for name in ("text", "answer"))
        some = [Item(r.item_id, w, a if r.answer is not None else w[-ANSWER_WORDS:]) for r, w, a in zip(rows, words, answers, strict=True) if len(w)]
        if some:
            found.append(search(tokens, Index(some, idf, basis)))
    if not found:
        return spark.createDataFrame([], match_schema(tokens))
    found = materialise(reduce(DataFrame.unionByName, found), "matches")
    best = F.max_by(F.struct("cosine", "lcs", "answer", "at"), F.struct("lcs", "cosine", -F.col("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a match, with all their columns."""
    hits = matches(docs.select(row_key().alias("doc_id"), "text"), benchmark)  # ids may be null or stand for several texts
    return without_rows(docs, hits.select(F.col("doc_id").alias("row_key")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, at of every match of a benchmark item in `documents`."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return matches(read("documents"), read("benchmark"))

"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(x.w - theta_k): one weight vector is shared by all ordered thresholds. The
features are the shares of words, and of word beginnings of three to six characters, that documents
labelled toxic hold more often than others (a two-proportion z statistic over hashed features).
Texts are read in windows of WINDOW words, a new one every STRIDE words, so that a toxic passage
weighs the same in a long text as in a short one; a text of at most WINDOW words is one window. The
model learns from each document's best window and a document gets the largest of its windows.
Grades: 0 where the label is 0; toxic documents are parted at the median of their summed features
into grade 1 and grade 2. Every document gets its expected severity, the sum of P(grade > k).

The model learns from at most TRAIN_ROWS labelled documents, taken in the order of their ids' hash,
and has at most MAX_FEATURES features, so what reaches the driver is bounded. Scoring covers all
documents and whole texts.

Defined results: null and empty texts have no features and get the severity of the thresholds
alone; without both labels the severity is 0 and nothing is toxic; repeated rows give repeated
results; a document labelled twice counts as its larger label; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import with_ids, with_labels
from .storage import bounded_batches, materialise

TRAIN_ROWS, MAX_FEATURES = 20_000, 50_000
BUCKETS, BEGINNINGS = 1 << 20, (3, 4, 5, 6)
#: A feature needs so many documents and such a z statistic.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Words of a window and between the beginnings of two; what is up to STRIDE words long lies whole in a window.
WINDOW, STRIDE = 100, 50
#: A feature's share of a window's words is scaled by SCALE and stops at 1.
SCALE, RIDGE, STEPS, RATE = 20.0, 1e-5, 400, 0.3
#: Fits; the windows of the first are those with the most features, later ones take the model before.
ROUNDS = 2
CACHED_WORDS = 300_000
WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one lower-case word."""
    forms = [b"w" + word.encode("utf-8", "surrogatepass")]
    forms += [b"p" + word[:n].encode("utf-8", "surrogatepass") for n in BEGINNINGS if len(word) >= n]
    return tuple(xxhash.xxh3_64_intdigest(f) % BUCKETS for f in forms)


class Columns(dict):
    """Word to the model columns of its features (mostly none); cleared when full."""

    def __init__(self, column_of: dict[int, int] | None):
        super().__init__()
        self.column_of = column_of

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = word_features(word)
        found = self[word] = ids if self.column_of is None else tuple(c for i in ids if (c := self.column_of.get(i)) is not None)
        return found


def present(text: str | None, columns: Columns) -> np.ndarray:
    """Distinct columns of a text."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.array([c for word in words for c in columns[word]], np.int64))


def windows(text: str | None, columns: Columns) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many windows a text has; window, column and value of every feature in each of them."""
    words = WORD.findall(text.lower()) if text else []
    hits = [(i, hit) for i, hit in enumerate(map(columns.__getitem__, words)) if hit]
    starts = np.minimum(np.arange(0, max(1, len(words) - WINDOW + STRIDE), STRIDE), max(0, len(words) - WINDOW))
    if not hits:
        return len(starts), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    column = np.array([c for _, hit in hits for c in hit], np.int64)
    position = np.repeat([i for i, _ in hits], [len(hit) for _, hit in hits])
    low, high = np.searchsorted(position, starts), np.searchsorted(position, starts + WINDOW)
    size = high - low
    at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
    key, n = np.unique(np.repeat(np.arange(len(starts)), size) * BUCKETS + column[at], return_counts=True)
    return len(starts), key // BUCKETS, key % BUCKETS, np.minimum(1.0, n * (SCALE / min(WINDOW, len(words))))


def best_window(text: str | None, columns: Columns, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Largest weighted sum over all windows of a text; columns and values of the first window that has it."""
    many, window, column, value = windows(text, columns)
    sums = np.bincount(window, weights=value * weights[column], minlength=many)
    best = int(sums.argmax())
    of = window == best
    return float(sums[best]), column[of], value[of]


def telling_features(train: DataFrame) -> DataFrame:
    """feature, z of the features that toxic documents hold more often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, held, seen = Columns(None), np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[int(label > 0), present(text, columns)] += 1
                seen[int(label > 0)] += 1
        at = np.flatnonzero(held.any(0))
        ids, clean, toxic = (np.append(x, y) for x, y in ((at, -1), (held[0, at], seen[0]), (held[1, at], seen[1])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "clean", "toxic"])

    counts = train.select("text", "label").mapInArrow(count, "feature int, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.filter("feature = -1").select(F.col("clean").alias("all_clean"), F.col("toxic").alias("all_toxic"))
    both = counts.filter(f"feature >= 0 AND clean + toxic >= {LEAST_DOCS}").join(F.broadcast(total), how="cross")  # one row
    both = both.filter("all_clean > 0 AND all_toxic > 0")
    share = (F.col("clean") + F.col("toxic")) / (F.col("all_clean") + F.col("all_toxic"))
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / F.col("all_clean") + 1 / F.col("all_toxic")))
    z = (F.col("toxic") / F.col("all_toxic") - F.col("clean") / F.col("all_clean")) / spread
    return both.select("feature", z.alias("z")).filter(F.col("z") >= LEAST_Z)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int) -> "Ordinal":
        """Maximum likelihood with a ridge, by AdaGrad; rare grades above 0 weigh as much as half of grade 0."""
        n, top = len(grade), int(grade.max())
        weights, first, gaps = np.zeros(columns), np.zeros(1), np.zeros(max(0, top - 1))
        share = np.where(grade > 0, max(1.0, (grade == 0).sum() / max(1, (grade > 0).sum()) / 2), 1.0) / n
        steps = [np.full(x.shape, 1e-8) for x in (weights, first, gaps)]
        rows = np.arange(n)
        for _ in range(STEPS):
            theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            eta = np.bincount(doc, weights=value * weights[column], minlength=n)
            above = np.concatenate([np.ones((n, 1)), sigmoid(eta[:, None] - theta), np.zeros((n, 1))], axis=1)  # P(grade >= k)
            slope = above * (1 - above)
            p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
            low, high = slope[rows, grade], slope[rows, grade + 1]
            by_eta = -share * (low - high) / p
            by_theta = np.zeros(top + 2)
            np.add.at(by_theta, grade, share * low / p)
            np.add.at(by_theta, grade + 1, -share * high / p)
            by_theta = by_theta[1:-1]
            tail = np.cumsum(by_theta[::-1])[::-1]
            slopes = (np.bincount(column, weights=value * by_eta[doc], minlength=columns) + RIDGE * weights, tail[:1], tail[1:] * np.exp(gaps))
            for x, d, s in zip((weights, first, gaps), slopes, steps, strict=True):
                s += d * d
                x -= RATE * d / np.sqrt(s)
        return cls(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))

    def above(self, eta: float) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return sigmoid(eta - self.thresholds)


class Model:
    def __init__(self, column_of: dict[int, int], ordinal: Ordinal | None):
        self.column_of, self.ordinal = column_of, ordinal

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> "Model":
        bounded_batches(docs.sparkSession)
        known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxic-labels")
        train = materialise(with_labels(with_ids(docs, known), known, "toxic").filter("label IS NOT NULL"), "toxic-train")
        best = telling_features(train).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
        column_of = {r.feature: i for i, r in enumerate(best)}
        if not column_of:
            return cls({}, None)
        weights = np.ones(len(column_of))
        for _ in range(ROUNDS):
            got = vectors(train, column_of, weights).toPandas()
            size = got["columns"].map(len).to_numpy()
            doc, column, value = np.repeat(np.arange(len(got)), size), np.concatenate(got["columns"].to_list()).astype(np.int64), np.concatenate(got["values"].to_list())
            toxic, signal = got["label"].to_numpy() > 0, np.bincount(doc, weights=value, minlength=len(got))
            grade = toxic.astype(np.int64) + (toxic & (signal > np.median(signal[toxic])))
            ordinal = Ordinal.fit(doc, column, value, grade, len(column_of))
            weights = ordinal.weights
        return cls(column_of, ordinal)


def vectors(rows: DataFrame, column_of: dict[int, int], weights: np.ndarray) -> DataFrame:
    """label, columns, values of every row's best window."""
    shared = rows.sparkSession.sparkContext.broadcast((column_of, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        columns = Columns(known)
        for batch in batches:
            got = [best_window(text, columns, w) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array([x[2] for x in got], pa.list_(pa.float64()))],
                names=["label", "columns", "values"],
            )

    return rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, columns array<long>, values array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, p_toxic, toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        columns = Columns(m.column_of)
        for batch in batches:
            p = [m.ordinal.above(best_window(text, columns, m.ordinal.weights)[0]) if m.ordinal else np.zeros(1) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(x.sum()) for x in p], pa.float64()), pa.array([float(x[0]) for x in p], pa.float64())],
                names=["doc_id", "severity", "p_toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double").withColumn("toxic", F.col("p_toxic") >= 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, p_toxic, toxic of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, Model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

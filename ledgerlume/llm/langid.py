"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with single spaces for all else; n-grams of one to three characters
are hashed into a fixed number of buckets. Training counts are summed by Spark, one row per language
and bucket, and become a log-probability matrix of fixed size (buckets x languages), which is
broadcast. Scoring multiplies a batch's sparse gram counts with it in numpy.

Defined results: a null text or one without a letter is `und` with score 0; whole texts are read at
any length; ties go to the language that sorts first; rows without a language never train; with no
training rows everything is `und`; repeated rows give repeated results; other columns are ignored.
The number of languages is taken from the labels and must stay within MAX_LANGUAGES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches

BUCKETS, ORDERS, SMOOTHING = 1 << 14, (1, 2, 3), 0.5
MAX_LANGUAGES = 512
#: Grams that one step of the product gathers.
STEP = 1 << 15
UNKNOWN = "und"

_folded: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to folded code point: lower case for letters, a space for the rest."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low[0]) if low[0].isalpha() else cp
        _folded.append(table)
    return _folded[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Bucket ids of all n-grams of a text, and whether it has a letter."""
    s = fold_table()[code_points(text)]
    letters = s != 32
    if not letters.any():
        return np.zeros(0, np.int64), False
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # of a run of other signs one space stays
    s = s[keep]
    s = np.concatenate([[np.uint32(32)], s, [np.uint32(32)]]) if s[-1] != 32 else np.concatenate([[np.uint32(32)], s])
    return gram_ids(s), True


def gram_ids(s: np.ndarray) -> np.ndarray:
    out, h = [], np.zeros(len(s), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(s) < n:
            break
        h = h[: len(s) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + s[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in ORDERS:
            m = h ^ (h >> np.uint64(31))
            m *= np.uint64(0xD6E8FEB86659FD93)
            out.append((m >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(out)


def held_out() -> Column:
    """The documents that never train: remainder 2 of their id's checksum."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows with a text and a language.

    Each task holds one count vector per language it meets, so the shuffle gets at most
    languages x buckets rows from a task, however many documents share a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, any_letter = grams(text)
                if any_letter:
                    into = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    into += np.bincount(ids, minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"]
            )

    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """The languages and log P(bucket | language); the prior is uniform."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.log_p = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])).T.copy()

    @classmethod
    def fit(cls, labelled: DataFrame) -> "Model":
        counts = train_counts(labelled)
        packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
        rows = sorted(packed.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)
        if len(rows) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if that is meant")
        matrix = np.zeros((len(rows), BUCKETS))
        for i, r in enumerate(rows):
            for bucket, n in r.cells:
                matrix[i, bucket] = n
        return cls([r.lang for r in rows], matrix)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its probability of every text: the batch's gram counts times the log-probabilities, as a sparse product."""
        found = [grams(text)[0] if text and self.languages else np.zeros(0, np.int64) for text in texts]
        size = np.array([len(ids) for ids in found], np.int64)
        flat, owner = np.concatenate([np.zeros(0, np.int64), *found]), np.repeat(np.arange(len(texts)), size)
        total = np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(flat), STEP):
            of = owner[low : low + STEP]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            total[of[first]] += np.add.reduceat(self.log_p[flat[low : low + STEP]], first, axis=0)
        known = size > 0
        best = total.argmax(1) if self.languages else np.zeros(len(texts), int)
        share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1) if self.languages else np.zeros(len(texts))
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], [float(x) if k else 0.0 for x, k in zip(share, known, strict=True)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, share = m.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Model.fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words and signs, their bigrams, and a shared bucket for a
word that repeats at once): one of the target texts (those labelled as good), one of all raw texts.
A document's log weight is the sum of log p_target - log p_raw over its n-grams. Adding Gumbel noise
to the log weights and taking the k largest draws k documents without replacement in proportion to
their weights. `k` is the number of documents whose log weight is at or above a level that best
parts labelled good from labelled bad documents. Every label counts twice, for the target model and
for the level: there a good document goes by the target model of all other good documents (leave one out),
which is the whole model less its own counts, so no label is set aside and no fold of them decides.

The models are sums over all documents, made by Spark, of fixed size. The level is exact over all labelled
documents: their weights are dealt by range, and every part adds up its counts on top of those of the parts
below. The k-th key is found by counting within ever finer bins, so no sort meets in one task, however
many keys are equal. The noise of a document depends on its id and SEED only.

Defined results: null and empty texts have log weight 0; whole texts are read; with no good or no
bad labels every document is taken; ties at the k-th key go to the smaller ids, and rows that repeat
an id share its noise; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import row_key, with_labels, without_rows
from .storage import bounded_batches, materialise
from .words import word_hashes
from .workers import claim

BUCKETS, SEED = 1 << 14, 11
#: Pseudo-counts of the target model per bucket, spread as the raw model's.
SMOOTHING = 4.0
#: Weight of lost good texts against kept bad ones, and the room left below good log weights for the Gumbel noise.
KEEP, SLACK = 10.0, 3.0
BINS, FINISH = 4096, 4096
#: Different weights of labelled documents in one part, and the least number of parts.
PART_WEIGHTS, PARTS = 1 << 18, 16
#: Documents in one file of weights.
NARROW = 1 << 17


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Bucket ids of each text's n-grams."""
    out = []
    for words in word_hashes(texts, symbols=True):
        both = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> np.uint64(20)
        again = np.count_nonzero(words[:-1] == words[1:])
        out.append(np.concatenate([words % np.uint64(BUCKETS), both % np.uint64(BUCKETS), np.full(again, BUCKETS, np.uint64)]).astype(np.int64))
    return out


def model_counts(labelled: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts of all documents and of the good ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            found = features(batch.column(0).to_pylist())
            good = [f for f, label in zip(found, batch.column(1).to_pylist(), strict=True) if label == 1]
            for n, some in ((raw, found), (target, good)):
                n += np.bincount(np.concatenate([np.zeros(0, np.int64), *some]), minlength=BUCKETS + 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(count, "bucket int, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def prior(raw: np.ndarray) -> np.ndarray:
    """Pseudo-counts of the target model: with few target texts the ratio shrinks towards 0."""
    return SMOOTHING * len(raw) * raw / raw.sum()


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of every bucket; 0 where nothing was seen."""
    if not target.any():
        return np.zeros(BUCKETS + 1)
    seen, smooth = raw > 0, target + prior(raw)
    ratio = np.zeros(BUCKETS + 1)
    ratio[seen] = np.log(smooth[seen] / smooth.sum()) - np.log(raw[seen] / raw.sum())
    return ratio


def weights_without(raw: np.ndarray, target: np.ndarray) -> Callable[[np.ndarray], float]:
    """The log weight of a good document's n-grams by the target model of all other good documents."""
    pseudo, good = prior(raw), target.sum()
    total = pseudo.sum() + good
    share = np.log(np.where(raw > 0, raw, 1) / raw.sum())

    def weight(found: np.ndarray) -> float:
        if len(found) >= good:  # no other has any n-gram
            return 0.0
        at, own = np.unique(found, return_counts=True)
        return float(((np.log((target[at] - own + pseudo[at]) / (total - len(found))) - share[at]) * own).sum())

    return weight


def fit_ratios(labelled: DataFrame) -> np.ndarray:
    """Three rows: the counts of all documents, those of the good ones, and the ratio."""
    raw, target = np.zeros((2, BUCKETS + 1))
    for r in model_counts(labelled).collect():  # at most BUCKETS + 1 rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return np.stack([raw, target, log_ratio(raw, target)])


def fit_ratio(labelled: DataFrame) -> np.ndarray:
    """The ratio of all good documents."""
    return fit_ratios(labelled)[-1]


def log_weights(labelled: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, label, log_weight, unseen_weight, row_key of every row.

    `ratios` are what `fit_ratios` gives, or a ratio alone. The unseen weight of a row labelled good is by the model of
    all other good ones (that of a ratio alone is its log weight); a bad one is in no model, so it is its log weight; it is
    null for other rows.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(np.atleast_2d(ratios))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        *counts, ratio = shared.value
        weight = weights_without(*counts) if counts and counts[1].any() else None
        for batch in batches:
            found, labels = features(batch.column(2).to_pylist()), batch.column(1).to_pylist()
            got = [float(ratio[f].sum()) for f in found]
            unseen = [None if label is None else weight(f) if weight and label == 1 else own for f, label, own in zip(found, labels, got, strict=True)]
            weights = [pa.array(got, pa.float64()), pa.array(unseen, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *weights, batch.column(3)], names=["doc_id", "label", "log_weight", "unseen_weight", "row_key"])

    rows = labelled.select("doc_id", F.col("label").cast("int").alias("label"), "text", row_key().alias("row_key"))
    return rows.mapInArrow(score, "doc_id long, label int, log_weight double, unseen_weight double, row_key binary")


def best_level(weights: np.ndarray, good: np.ndarray) -> float:
    """The level that best parts good from bad, SLACK below the first good weight over the gap.

    A lost share of good texts weighs KEEP times as much as the same share of bad ones let through.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept_good = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    kept_bad = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    new = np.concatenate([[True], w[1:] > w[:-1], [True]])  # a level can't part equal weights
    at = int(np.where(new, KEEP * kept_good - kept_bad, -np.inf).argmax())
    return -np.inf if at == 0 else below(w[at - 1], w[at]) if at < len(w) else np.inf


def below(low: float, high: float) -> float:
    """The level in the gap between two neighbouring weights of which the higher one stays."""
    return float(max((low + high) / 2, high - SLACK))


def level_of(known: DataFrame) -> float:
    """What `best_level` finds for all rows of `known` (weight, good), however many: counts by weight, added up within ranges."""
    counted = known.groupBy("weight").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    n = counted.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    if not n[1] or not n[2]:
        return -np.inf
    parts = max(PARTS, -(-n[0] // PART_WEIGHTS))
    dealt = materialise(counted.repartitionByRange(parts, "weight").withColumn("part", F.spark_partition_id()), "levels", n[0], PART_WEIGHTS)
    before, rows = [0, 0], []
    for r in dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect():  # a row a part
        rows.append((r.part, *before))
        before = [before[0] + r.good, before[1] + r.bad]
    table = pa.table(list(zip(*rows, strict=True)), names=["part", "good_below", "bad_below"])  # rows as a list would go through Python workers
    offsets = F.broadcast(known.sparkSession.createDataFrame(table))
    here = Window.partitionBy("part").orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda name, total: F.lit(total) - F.col(f"{name}_below") - F.coalesce(F.sum(name).over(here), F.lit(0))
    cuts = dealt.join(offsets, "part").select("weight", left("good", n[1]).alias("good"), left("bad", n[2]).alias("bad"))
    worth = F.expr(f"CAST({KEEP} AS DECIMAL(6,3)) * CAST(good AS DECIMAL(13,0)) * CAST({n[2]} AS DECIMAL(13,0)) - CAST(bad AS DECIMAL(13,0)) * CAST({n[1]} AS DECIMAL(13,0))")
    high = cuts.orderBy(worth.desc(), "weight").first()["weight"]
    low = dealt.filter(F.col("weight") < F.lit(high)).agg(F.max("weight")).first()[0]
    return -np.inf if low is None else below(low, high)


def with_keys(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Add `gumbel_key`, the log weight with the document's Gumbel noise."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))


def nth_value(rows: DataFrame, column: str, n: int, descending: bool):
    """The n-th value of a column without nulls, by counting in ever finer bins; at most FINISH values or one are collected."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = rows.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        some = [r[0] for r in inside.select(column).limit(FINISH + 1).collect()]
        if len(some) <= FINISH:
            return sorted(some, reverse=descending)[n - 1]
        width = (high - low) / BINS
        number = F.least(F.lit(BINS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        bins = inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(bins, key=lambda r: r.bin, reverse=descending):  # at most BINS rows
            if n <= r.n:
                if (r.a, r.b) == (low, high):  # neighbours in floating point, which bins can't part: the nearer end, if enough rows have it
                    end = high if descending else low
                    many = inside.filter(F.col(column) == F.lit(end)).count()
                    if n <= many:
                        return end
                    n -= many
                    low, high = inside.filter(F.col(column) != F.lit(end)).agg(F.min(column), F.max(column)).first()
                    break
                low, high = r.a, r.b
                break
            n -= r.n
    return low


def kth_key(keys: DataFrame, k: int) -> tuple[float, int | None]:
    """The k-th largest (gumbel_key, smaller doc_id first) of written keys; no id: every row with that key is taken."""
    key = nth_value(keys, "gumbel_key", k, True)
    ties = keys.filter((F.col("gumbel_key") == F.lit(key)) & F.col("doc_id").isNotNull())
    left = k - keys.filter(F.col("gumbel_key") > F.lit(key)).count()
    return key, nth_value(ties, "doc_id", left, False) if ties.count() >= left else None


def drawn(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected, row_key of every row of `docs`."""
    bounded_batches(docs.sparkSession)
    labelled = with_labels(docs, labels, "quality")
    scored = materialise(with_keys(log_weights(labelled, fit_ratios(labelled)), seed), "log-weights", docs.count(), NARROW)
    level = level_of(scored.filter("label IS NOT NULL").select(F.col("unseen_weight").alias("weight"), (F.col("label") == 1).alias("good")))
    total = scored.count()
    k = scored.filter(F.col("log_weight") >= F.lit(level)).count()
    taken = F.lit(k == total)
    if 0 < k < total:
        key, last = kth_key(scored, k)
        taken = (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & (F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))))
    return scored.select("doc_id", "log_weight", "gumbel_key", taken.alias("selected"), "row_key")


def select(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every row of `docs`."""
    return drawn(docs, labels, seed).drop("row_key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns."""
    return without_rows(docs, drawn(docs, labels).filter("NOT selected"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every document."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return select(read("documents"), read("labels"))

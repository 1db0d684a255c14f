"""The corpus preparation pipeline: filter, deduplicate, decontaminate, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; `run` writes
each stage's rows to the shared folder before the next one reads them, and then deletes what the stage
itself had written there. All stages but the last return the columns of `documents`, extra ones too; the
last returns doc_id, n_tokens, ids_sha256, decoded_sha256.

Rows are told apart by id and text: null ids and ids that stand for several texts lose no document. A null
text is the empty text. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlume.llm import bpe, decontaminate, exact_dedup, minhash, quality
from ledgerlume.llm.storage import fresh_path, scratch


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the one with the smallest id stays."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stays."""
    return bpe.digests(bpe.round_trip(docs, bpe.rank_file()))


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: The stages learn models and walk graphs; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

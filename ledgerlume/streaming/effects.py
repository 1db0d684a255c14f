"""A consumer of a stream whose effects happen once: stateful deduplication by key, and output named by batch.

The state store remembers every key for good, so no batch reads the log of the ones before. A batch that was
written but not committed is worked out again from the state before it and replaces its own folder, so neither
a lost executor nor a driver that stops between writing and committing repeats an effect.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed value: how often the consumer looks for work.
POLL = "2 seconds"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def consume(stream: DataFrame, key: str, effect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a query that applies `effect` to the first row of every key and writes it to `path`, rows without a key to `path`-rejects.

    Rows of one key are one event that was delivered again: any of them may be the one that counts. `once` works
    off what is there and ends; otherwise the source is polled. `after_write` runs before a batch is committed.
    """
    spark = stream.sparkSession
    keyed = stream.withColumn("_rejected", F.when(F.col(key).isNull(), F.expr("uuid()")))  # rows without a key are told apart

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        effect(rows.filter("_rejected IS NULL").drop("_rejected")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.filter("_rejected IS NOT NULL").drop("_rejected").write.mode("overwrite").parquet(f"{path}-rejects/batch={number}")
        rows.unpersist()
        if after_write:
            after_write(number)

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = keyed.dropDuplicates([key, "_rejected"]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def effects(spark: SparkSession, path: str) -> DataFrame:
    """What happened, with the batch it happened in."""
    return spark.read.parquet(path)

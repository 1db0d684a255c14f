"""Intermediate tables in the folder that driver and executors share.

Long jobs cut their lineage by writing a table and reading it back: a lost executor then costs a
reread of files, not a recomputation. The folder is `spark.checkpoint.dir`; where that setting is
absent a private one is made, but only if driver and executors are one process (local mode, unit
tests). Results are lazy and read these tables, so an operator can't delete them itself; a caller
that has written its result wraps the work in `scratch`.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables, through Spark's own file systems."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so once the driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables made within, at its end: whatever reads them must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, *_open.pop())
        release(spark)


#: Rows and bytes in one Arrow batch between the JVM and Python: texts are long, and both sides hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; the settings stay, as plans run after the operator returned them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Files of a table whose size is known stay at least so many.
LEAST_FILES = 16


def write_table(frame: DataFrame, label: str, rows: int | None = None, per_file: int = 1 << 20) -> str:
    """Write `frame` once as Parquet in the shared folder; its path.

    With a bound on its rows, its last stage has at most a task (and a file) for every `per_file` of them, so
    that narrow tables aren't hundreds of tiny files; fewer partitions than that stay as they are.
    """
    path = fresh_path(frame.sparkSession, label)
    if rows is not None:
        frame = frame.coalesce(max(LEAST_FILES, -(-rows // per_file)))
    frame.write.parquet(path)
    return path


def materialise(frame: DataFrame, label: str, rows: int | None = None, per_file: int = 1 << 20) -> DataFrame:
    """Write `frame` once as Parquet in the shared folder and return it as read back."""
    return frame.sparkSession.read.schema(frame.schema).parquet(write_table(frame, label, rows, per_file))

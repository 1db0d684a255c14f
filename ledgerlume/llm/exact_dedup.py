"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keeps one state row per digest, without a watermark and so
without expiry, in the RocksDB (disk-backed) state store. The row holds the document that stays, as
its stable identifier (the largest id) and its content locator (file and row within it), and the
number of copies. Digests with more than one copy are hits; their whole texts are fetched again by
their rows' locators and compared byte for byte, and a digest that covers different texts is split
by text. The locators also tell the rows of `deduplicate` apart, whatever their ids.

Hot keys are combined on the map side before the shuffle, so a digest with a third of all rows costs
one state row and one record per task; rows find their group by `joins.by_key`, which broadcasts the
few hot digests and shuffles for the rest.

Defined results: a null text is the empty text; texts are equal when their UTF-8 bytes are equal;
null ids never win against an id; of rows with the winning id (or of rows without any id) one stays,
the last by locator, so `deduplicate` returns one row a text. Rows repeated with id and text count in
`group_size` and carry the same `keep_id` and `kept`. An empty table gives an empty result. Other
columns of the input are never looked at. A table that isn't read from files is written to the
shared folder first, as only files have locators.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import by_key, sized
from .storage import fresh_path, materialise

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store while a deduplication stream runs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes for its logs
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # the shared file system has its own: half as many small files
}
#: Up to so many locators (about 200 bytes each once hashed) a side is broadcast; beyond it that join shuffles.
BROADCAST_LOCATORS = 100_000
#: Rows of digests and locators in one file of an intermediate table.
NARROW = 1 << 18
#: The columns of a locator.
FILE, ROW = "__locator_file", "__locator_row"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256_digest(text: Column) -> Column:
    """The default digest: 32 bytes."""
    return F.unhex(F.sha2(text, 256))


#: What may stand between a table and its files if every row of it is to be one row of a file.
ROWWISE = "Project", "Filter", "SubqueryAlias", "View"


def rows_of_files(docs: DataFrame) -> bool:
    """Whether `docs` is files under filters and projections; exploded, joined or united rows share locators or have none."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ROWWISE:
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """`docs` with the locator of every row; written and read again where its rows aren't those of files."""
    if rows_of_files(docs):
        try:
            return docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        except AnalysisException:  # projected away, or a source without such rows
            pass
    return located(materialise(docs, "located"))


def digest_log(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """doc_id, digest, file, row of every row of a located table; the narrow stream that the state is built from."""
    return docs.select("doc_id", digest(content()).alias("digest"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def content() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


#: The document that stays: ids before nulls, then the last locator.
LAST = "doc_id", "file", "row"


def keyed_state(spark: SparkSession, log_path: str, checkpoint: str, schema, bytes_per_batch: int = 2 << 30) -> DataFrame:
    """Run the stream over the log files that `checkpoint` hasn't seen and return the whole state.

    Calling it again with the same checkpoint after new files arrived continues from the stored
    state: digest, stays (doc_id, file, row), group_size.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(log_path)
    state = stream.groupBy("digest").agg(F.max(F.struct(*LAST)).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    with _settings(spark, STATE_CONF):
        run = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
        names = held.schema["value"].dataType.names  # the aggregation's buffers go by the names of their functions
        if sorted(names) != ["count", "max"]:
            raise RuntimeError(f"the state holds {names}, not one maximum and one count")
        return held.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("stays"), F.col("value.count").alias("group_size"))


def exact_groups(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept."""
    return located_groups(located(docs), digest).select(
        "doc_id", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("stays.doc_id")).alias("kept")
    )


def located_groups(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """One row per row of a located table: doc_id, file, row, digest, stays, group_size."""
    spark = docs.sparkSession
    log_path, checkpoint = fresh_path(spark, "digest-log"), fresh_path(spark, "digest-state")
    log = digest_log(docs, digest)
    log.write.parquet(log_path)
    log = spark.read.schema(log.schema).parquet(log_path)
    rows = log.count()
    state = materialise(keyed_state(spark, log_path, checkpoint, log.schema), "digest-groups", rows, NARROW)
    groups = materialise(by_key(log, state, "digest", "group_size", rows), "grouped-rows", rows, NARROW)

    hits = groups.filter("group_size > 1").select(F.col("file").alias("hit_file"), F.col("row").alias("hit_row"))
    texts = docs.select("doc_id", FILE, ROW, digest(content()).alias("digest"), content().alias("content"))
    texts = texts.join(sized(hits, hits.count(), BROADCAST_LOCATORS), (F.col(FILE) == F.col("hit_file")) & (F.col(ROW) == F.col("hit_row")), "left_semi")
    compared = texts.groupBy("digest").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    mixed = compared.filter("least <> most").select("digest")
    if not mixed.limit(1).count():
        return groups
    # different texts under one digest: the bytes decide
    split = texts.join(mixed, "digest", "left_semi").select("doc_id", F.col(FILE).alias("file"), F.col(ROW).alias("row"), "digest", "content")
    by_text = split.groupBy("digest", "content").agg(F.max(F.struct(*LAST)).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    exact = split.join(by_text, ["digest", "content"]).select(groups.columns)
    return groups.join(mixed, "digest", "left_anti").select(groups.columns).unionByName(exact)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, one per text, with all columns of `docs`; ids may be null or stand for several texts."""
    rows = located(docs)
    stays = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
    gone = located_groups(rows).filter(~stays).select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row"))
    gone = sized(gone, gone.count(), BROADCAST_LOCATORS)
    kept = rows.join(gone, (F.col(FILE) == F.col("__gone_file")) & (F.col(ROW) == F.col("__gone_row")), "left_anti")
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

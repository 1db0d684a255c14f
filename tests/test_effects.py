import pytest
from pyspark.sql import functions as F

from ledgerlume.streaming import effects as E

SCHEMA = "payment string, amount int"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def start(spark, source, out, **more):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    return E.consume(stream, "payment", lambda rows: rows.withColumn("months", F.floor(F.col("amount") / 10)), f"{out}/effects", f"{out}/checkpoint", **more)


def test_no_effect_is_repeated_after_a_stop_before_commit(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path)
    put(spark, source, "a", [("p1", 10), ("p2", 20), ("p1", 10), (None, 1), (None, 1)])

    def stop(number):
        raise RuntimeError("stopped between writing and committing")

    with pytest.raises(Exception, match="stopped between"):
        start(spark, source, out, after_write=stop).awaitTermination()
    start(spark, source, out).awaitTermination()
    put(spark, source, "b", [("p2", 20), ("p3", 30), ("p1", 10)])
    start(spark, source, out).awaitTermination()
    start(spark, source, out).awaitTermination()  # nothing new
    got = sorted((r.payment, r.months) for r in E.effects(spark, f"{out}/effects").collect())
    assert got == [("p1", 1), ("p2", 2), ("p3", 3)]
    assert spark.read.parquet(f"{out}/effects-rejects").count() == 2


def test_polling(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path)
    put(spark, source, "a", [("p1", 10)])
    running = start(spark, source, out, once=False)
    try:
        running.processAllAvailable()
        put(spark, source, "b", [("p1", 10), ("p2", 20)])
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r.payment for r in E.effects(spark, f"{out}/effects").collect()) == ["p1", "p2"]

"""Comparison of two runs' results: JSON records flattened to paths, joined by path, volatile paths left out.

A record is flattened inside its row, one level per step; the paths of both runs meet in one shuffle by file
and path, so a file with very many paths is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that differ in every run, the parts of a record, what a part that isn't there is called.
VOLATILE = r"(^|\.)(_meta\.extractionMs|extractionMs|timestamp|gerado_em|processado_em|duracaoMs)$"
PARTS = ("roteamento", "resultado", "erro")
UNDEFINED = "undefined"
NEW, GONE, SAME, EXPECTED, CHANGED = "NOVO", "SUMIU", "IDENTICO", "ESPERADO", "ALTERADO"


def _name(prefix: Column, key: Column) -> Column:
    return F.when(prefix == "", key).otherwise(F.concat(prefix, F.lit("."), key))


def _opened(item: Column) -> Column:
    """One level of a value: its members with their paths, or the value itself; empty objects and arrays have no members."""
    kind = F.schema_of_variant(item["v"])
    made = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    members = F.transform(F.map_entries(item["v"].try_cast("map<string,variant>")), lambda e: made(_name(item["path"], e["key"]), e["value"]))
    elements = F.transform(item["v"].try_cast("array<variant>"), lambda e, i: made(_name(item["path"], i.cast("string")), e))
    return F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), elements).otherwise(F.array(made(item["path"], item["v"])))


def _text(value: Column) -> Column:
    """A value as text: null as 'null', numbers without trailing zeros."""
    text = value.try_cast("string")
    number = F.schema_of_variant(value).rlike("^(DECIMAL|DOUBLE|FLOAT)")
    short = F.regexp_replace(F.regexp_replace(text, r"^(-?\d+\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(number, short).otherwise(text), F.lit("null"))


def flattened(records: DataFrame, depth: int = 12, parts: Sequence[str] = PARTS) -> DataFrame:
    """file, path, value of every leaf of `records` (file, record as JSON), array positions as parts of the path.

    Parts that a record doesn't have are 'undefined'. What lies deeper than `depth` levels is one value, its JSON.
    A null record or text that isn't JSON has no parts.
    """
    rows = records.select("file", F.coalesce(F.try_parse_json("record"), F.parse_json(F.lit("{}"))).alias("v"))
    keys = F.coalesce(F.map_keys(F.col("v").try_cast("map<string,variant>")), F.array().cast("array<string>"))
    rows = rows.select("file", F.array_except(F.array(*map(F.lit, parts)), keys).alias("missing"), F.array(F.struct(F.lit("").alias("path"), F.col("v").alias("v"))).alias("items"))
    for _ in range(depth):
        rows = rows.withColumn("items", F.flatten(F.transform("items", _opened)))
    leaves = F.transform("items", lambda x: F.struct(x["path"].alias("path"), _text(x["v"]).alias("value")))
    gone = F.transform("missing", lambda p: F.struct(p.alias("path"), F.lit(UNDEFINED).alias("value")))
    return rows.select("file", F.inline(F.concat(leaves, gone)))


def changes(before: DataFrame, after: DataFrame, volatile: str = VOLATILE, depth: int = 12) -> DataFrame:
    """file, path, before, after of every path that differs, added and removed ones too, of files that both runs have.

    A file is expected once per run; of several records with one file and path the greatest value counts.
    """
    side = lambda records, name: flattened(records, depth).filter(~F.col("path").rlike(volatile)).select("file", "path", "value", F.lit(name).alias("side"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    rows = side(before, "a").unionByName(side(after, "b")).groupBy("file", "path").agg(of("a").alias("before"), of("b").alias("after"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after"))).join(_present(before, after).filter("old AND new"), "file", "left_semi")


def _present(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = before.select("file", F.lit(True).alias("old"), F.lit(False).alias("new")).unionByName(after.select("file", F.lit(False).alias("old"), F.lit(True).alias("new")))
    return rows.groupBy("file").agg(F.max("old").alias("old"), F.max("new").alias("new"))


def file_states(before: DataFrame, after: DataFrame, changed: DataFrame, expected: DataFrame) -> DataFrame:
    """file, state, n_changes: new, gone, unchanged, changed as expected (file in `expected`) or changed."""
    counts = changed.groupBy("file").agg(F.count(F.lit(1)).alias("n_changes"))
    rows = _present(before, after).join(counts, "file", "left").join(expected.select("file").distinct().withColumn("wanted", F.lit(True)), "file", "left")
    n = F.coalesce("n_changes", F.lit(0)).cast("long")
    state = F.when(~F.col("old"), NEW).when(~F.col("new"), GONE).when(n == 0, SAME).when(F.col("wanted"), EXPECTED).otherwise(CHANGED)
    return rows.select("file", state.alias("state"), n.alias("n_changes"))


def verdict(states: DataFrame) -> DataFrame:
    """compared, expected, unexpected, new, regression: what a run's comparison comes to; a file that is gone is unexpected."""
    n = lambda *kinds: F.count_if(F.col("state").isin(*kinds))
    return states.agg(
        n(GONE, SAME, EXPECTED, CHANGED).alias("compared"), n(EXPECTED).alias("expected"), n(GONE, CHANGED).alias("unexpected"), n(NEW).alias("new"), (n(GONE, CHANGED) > 0).alias("regression")
    )

"""Versions of documents as whole snapshots: what each one changes against the one before, and any two compared.

A snapshot is a map from field to value. Numbering and the look at the version before share one sort by document;
only two snapshots are side by side at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_diff(old: Column, new: Column) -> Column:
    """Fields that differ between two maps, by name: (field, before, after); a field that a map lacks is null, one that holds null is 'null'.

    A null map is an empty one.
    """
    told = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("null")))
    both = F.map_entries(F.map_zip_with(told(old), told(new), lambda k, a, b: F.struct(a.alias("before"), b.alias("after"))))
    rows = F.transform(both, lambda e: F.struct(e["key"].alias("field"), e["value"]["before"].alias("before"), e["value"]["after"].alias("after")))
    return F.array_sort(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"])))


def versions(snapshots: DataFrame) -> DataFrame:
    """document, seq, version, label, snapshot, changes of (document, seq, label, snapshot): every snapshot numbered from 1, with its difference.

    The first version adds all its fields; a snapshot like the one before is a version without changes.
    """
    w = Window.partitionBy("document").orderBy("seq")
    rows = snapshots.select("document", "seq", "label", "snapshot", F.row_number().over(w).alias("version"), F.lag("snapshot").over(w).alias("before"))
    return rows.select("document", "seq", "version", "label", "snapshot", map_diff(F.col("before"), F.col("snapshot")).alias("changes"))


def changes(numbered: DataFrame) -> DataFrame:
    """document, version, kind, field, before, after: one row per changed field of every version."""
    rows = numbered.select("document", "version", F.inline("changes"))
    kind = F.when(F.col("before").isNull(), "ADICIONADO").when(F.col("after").isNull(), "REMOVIDO").otherwise("ALTERADO")
    return rows.select("document", "version", kind.alias("kind"), "field", "before", "after")


def compare(numbered: DataFrame, first: int, second: int) -> DataFrame:
    """document, field, before, after between two versions of every document that has both; one combined aggregate, no join."""
    rows = numbered.filter(F.col("version").isin(first, second))
    of = lambda v: F.max_by("snapshot", F.when(F.col("version") == v, v))
    both = rows.groupBy("document").agg(of(first).alias("old"), of(second).alias("new"), F.count_distinct("version").alias("n"))
    return both.filter(F.col("n") == (1 if first == second else 2)).select("document", F.inline(map_diff(F.col("old"), F.col("new"))))


def as_of(numbered: DataFrame, label: str) -> DataFrame:
    """document, version, snapshot of the latest version with a label."""
    rows = numbered.filter(F.col("label") == label).groupBy("document").agg(F.max_by(F.struct("version", "snapshot"), "version").alias("x"))
    return rows.select("document", "x.version", "x.snapshot")

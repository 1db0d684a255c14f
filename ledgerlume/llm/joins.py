"""Joins of documents with narrow tables of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many ids (about 40 bytes each once hashed) a side is broadcast; beyond it both sides shuffle.
BROADCAST_IDS = 500_000
#: The same for row keys, which take about twice the room.
BROADCAST_KEYS = 250_000


def sized(frame: DataFrame, rows: int, most: int = BROADCAST_IDS) -> DataFrame:
    """`frame` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(frame) if rows <= most else frame


#: A key with over 1 / HOT of all rows is hot, so there are fewer than HOT of them.
HOT = 1000


def by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows`, `total` at most, with `groups`: one row a key, whose column `size` counts the rows of that key.

    The hot keys, fewer than HOT whatever the tables hold, are broadcast; the other rows are dealt by key, and none of
    these keys has over 1 / HOT of them.
    """
    wide = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * HOT > total).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.filter("__hot IS NULL").select(rows.columns).join(groups.filter(F.col(size) * HOT <= total), key)
    return marked.filter("__hot").select(*rows.columns, *wide).unionByName(cold.select(*rows.columns, *wide))


def row_key() -> Column:
    """32 bytes that tell rows with another id or text apart; ids may be null or stand for several texts. A null text is the empty text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` whose key isn't in the column row_key of `keys`."""
    gone = keys.select(F.col("row_key").alias("__gone_key")).distinct()
    return docs.join(sized(gone, gone.count(), BROADCAST_KEYS), row_key() == F.col("__gone_key"), "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, drop: bool = False) -> DataFrame:
    """Rows of `docs` whose doc_id is (with `drop`: isn't) in the first column of `ids`; null equals null.

    Narrow wanted sides keep the texts where they are; the smaller way is taken by a count.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("__wanted_id")).distinct()
    wanted = sized(wanted, wanted.count())
    return docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__wanted_id")), "left_anti" if drop else "left_semi")


def with_labels(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """doc_id, text and the label `name` (null where there is none); repeated labels count as their largest."""
    known = labels.filter(f"doc_id IS NOT NULL AND {name} IS NOT NULL").groupBy(F.col("doc_id").alias("__label_id")).agg(F.max(name).alias("label"))
    known = sized(known, labels.count())
    rows = docs.select("doc_id", "text")
    return rows.join(known, rows["doc_id"] == F.col("__label_id"), "left").select("doc_id", "text", "label")

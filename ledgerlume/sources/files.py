"""File sources and sinks: JSON lines, binary uploads, spreadsheets' sheets, HTML reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPLOAD_LIMIT = 50 * 1024 * 1024


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Append-only logs; broken lines are kept in `_broken` instead of failing the read."""
    wanted = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    return spark.read.option("columnNameOfCorruptRecord", "_broken").json(path, schema=f"{wanted}, _broken string")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_uploads(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Uploaded files up to the size limit; larger ones are left out before their bytes are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter(F.col("length") <= UPLOAD_LIMIT)


def missing_blobs(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the table doesn't hold yet."""
    return files.join(known.select("path"), "path", "left_anti")


def first_blob(disk: DataFrame, table: DataFrame) -> DataFrame:
    """Content by path: the file's, else the table's."""
    a, b = disk.select("path", F.col("content").alias("on_disk")), table.select("path", F.col("content").alias("in_table"))
    return a.join(b, "path", "full_outer").select("path", F.coalesce("on_disk", "in_table").alias("content"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key over both tables."""
    rows = current.unionByName(changes)
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def sheets(invoices: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of the spreadsheet export, as tables to be written by any sink."""
    detail = invoices.select("number", "status", "issued", "customer_id", "gross", "net")
    return {
        "resumo": invoices.groupBy("status").agg(F.count(F.lit(1)).alias("invoices")),
        "notas": detail.orderBy("issued", "number"),
        "fiscal": invoices.select("number", "rate", "iss", "gross"),
    }


def html_report(rows: DataFrame, title: str, most: int) -> str:
    """An HTML page of the first `most` rows of an ordered listing."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('—' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows.limit(most).collect())
    return f"<h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def glyph_text(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, text from placed glyphs: a line break where y moves, a space over a wide gap."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    gap = F.col("x") - (F.lag("x").over(order) + F.lag("width").over(order))
    first = F.lag("seq").over(order).isNull()
    joint = F.when(first, "").when(F.abs(F.col("y") - F.lag("y").over(order)) > 0.5, "\n").when(gap > F.greatest(F.lit(0.8), 0.18 * F.col("font")), " ").otherwise("")
    rows = glyphs.select("doc_id", "page", "seq", F.concat(joint, F.col("str")).alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return rows.groupBy("doc_id", "page").agg(F.array_join(pieces["piece"], "").alias("text"))

"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.business import TABLES, frame, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, tables: str = ""):
    """Register a query that takes (get, spark, sf_dir), where get(name) is a business or driver table."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def get(table: str) -> DataFrame:
                return frame(spark, sf_dir, table) if table in TABLES else spark.read.parquet(f"{sf_dir}/{table}.parquet")

            return build(get, spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = with_tables(oracle, *tables.split()) if tables else oracle
        return build

    return add

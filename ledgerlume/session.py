"""Session settings shared by tests, the bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "ledgerlume", cpus: int | str | None = None, partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller passes its own session to every function instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

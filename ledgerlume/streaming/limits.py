"""Streams: rate limits with keyed state, and metrics over event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited_stream(events: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, at, allowed: fixed windows that open with a caller's first event.

    State per caller is two numbers; it is dropped once the watermark is two windows past its opening.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            if opened is None or at >= opened + seconds:
                opened, used = int(at), 0
            used += 1
            allowed.append(used <= most)
        state.update((opened, used))
        state.setTimeoutTimestamp(max((opened + 2 * seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(user_id=key[0], allowed=allowed)[["user_id", "event_id", "at", "allowed"]]

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "ts", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, at long, allowed boolean", "opened long, used long", "append", GroupStateTimeout.EventTimeTimeout
    )


def metric_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per event type and tumbling window, closed by a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")

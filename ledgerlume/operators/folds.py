"""Order-dependent folds: rows of a key in order, a small state, one pass.

Rows are dealt by key, sorted inside their partition and streamed through the fold batch by batch,
so a key's rows are never held together in memory, however many it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def ordered_fold(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """Rows (key, *order, *columns) through `step(state, row) -> (state, outputs)`, a fresh state per key.

    The outputs of a row are appended to its key and order columns; `out` is their schema.
    """
    names = [key, *order, *columns]
    rows = df.select(*names)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in [key, *order])
    n, width = len(names), 1 + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            results = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True):
                if row[0] != now:
                    now, state = row[0], start()
                state, extra = step(state, row)
                results.append(extra)
            fields = [batch.column(i) for i in range(width)]
            extras = [pa.array([r[i] for r in results]) for i in range(len(out.split(",")))] if results else [pa.array([], pa.null()) for _ in out.split(",")]
            if results:
                yield pa.RecordBatch.from_arrays([*fields, *extras], names=[*names[:width], *[c.split()[0] for c in out.split(",")]])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kept}, {out}")


def rate_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Whether each event of a caller is let through: at most `most` in windows that open with a caller's first event."""

    def step(state, row):
        opened, used = state
        at = row[1]
        if opened is None or at >= opened + seconds:
            opened, used = at, 0
        used += 1
        return (opened, used), (used <= most,)

    rows = events.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return ordered_fold(rows, "user_id", ["at", "event_id"], [], lambda: (None, 0), step, "allowed boolean")

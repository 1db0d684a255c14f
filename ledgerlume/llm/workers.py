"""What Python workers keep from task to task."""

from __future__ import annotations

import pyarrow as pa

_held: dict[str, dict] = {}


def claim(owner: str) -> dict:
    """Objects that the tasks of one operator share in this worker; those of other operators are dropped.

    Spark reuses workers, so without this a worker would hold the caches of every operator it ever ran. A worker
    that gets no task of the next operator keeps what it has until Spark ends it, so caches are small as well.
    """
    others = [k for k in _held if k != owner]
    for other in others:
        del _held[other]
    if others:
        pa.default_memory_pool().release_unused()
    return _held.setdefault(owner, {})

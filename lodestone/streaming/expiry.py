"""Keyed state that leaves the store once the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

#: How far rows may lag behind the latest one before they are dropped.
LATE = "10 minutes"


def expiring(stream: DataFrame, key: str, time: str, late: str, step: Callable, output: str, state_schema: str,
             idle_ms: int | None, ends: Callable | None = None) -> DataFrame:
    """Per key and micro-batch, ``step(key, rows, state) -> (output rows, new state)``; a state is a tuple or null.

    A state ends ``idle_ms`` after the key's last row, or at ``ends(state)`` in milliseconds if given, and is removed by an event-time
    timer when the watermark passes that; with neither it stays for ever and no watermark is set.  Appends.
    """
    if idle_ms is None and ends is None:
        timed, mode = stream, GroupStateTimeout.NoTimeout
    else:
        if dict(stream.dtypes)[time] != "timestamp":
            raise TypeError(f"state can expire only by a timestamp: {time} is {dict(stream.dtypes)[time]}")
        timed, mode = stream.withWatermark(time, late), GroupStateTimeout.EventTimeTimeout
    names = StructType.fromDDL(output).names

    def run(keys, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        rows = pd.concat(list(frames))
        out, new = step(keys[0], rows, state.get if state.exists else None)
        state.update(new)
        if mode != GroupStateTimeout.NoTimeout:
            latest = int(rows[time].max().value // 1_000_000)
            end = ends(new) if ends else max(latest, state.getCurrentWatermarkMs()) + idle_ms
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return timed.groupBy(key).applyInPandasWithState(run, output, state_schema, "append", mode)

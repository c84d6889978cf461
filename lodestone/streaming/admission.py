"""Rate limits: windows that open with the first event of a key and are not extended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.streaming.expiry import LATE, expiring

OUTPUT = "key string, event_id bigint, micros bigint, window_start bigint, admitted boolean"


def _timed(events: DataFrame) -> DataFrame:
    """Times as microseconds; times without a zone count as UTC whatever the session's zone."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    else:
        micros = F.unix_micros("ts")
    return events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("bigint").alias("event_id"), micros.alias("micros"))


def _judge(limit: int, micros: int):
    """The rule for one event: (start, count) and a time → (start, count, admitted)."""
    def judge(start, count, at):
        if start is None or at >= start + micros:
            return at, 1, True
        if count >= limit:
            return start, count, False
        return start, count + 1, True

    return judge


#: Events of a key that a task judges in one go, about: a busy stretch is cut at the bucket in which it passes this.
CHUNK_EVENTS = 100_000
NEVER = -(1 << 62)


def _passage(micros: int, limit: int):
    """What a chunk does to any window that reaches into it.

    Entering, all that matters is which event opens the first window of the chunk: one of its first bucket, or the first one behind
    it.  For each of these comes the last window that opens in the chunk, and its events.
    """
    def run(frame):
        import numpy as np
        import pandas as pd

        at = np.sort(frame["micros"].to_numpy(np.int64))
        last = np.searchsorted(at, at + micros)
        last = np.where(last < len(at), last, np.arange(len(at)))
        while not (last[last] == last).all():
            last = last[last]
        edge = np.searchsorted(at, (at[0] // micros + 1) * micros)
        opening = np.unique(np.searchsorted(at, at[:edge + 1]))
        start = np.searchsorted(at, at[last[opening]])
        return pd.DataFrame({"key": frame["key"].iloc[0], "_island": frame["_island"].iloc[0], "_chunk": frame["_chunk"].iloc[0],
                             "opening": at[opening], "start": at[start], "count": np.minimum(len(at) - start, limit)})

    return run


def _entries(micros: int):
    """The open window in which each chunk of an island begins, by following the passages; there are few rows a chunk."""
    def run(frame):
        import pandas as pd

        out, start, count = [], NEVER, 0
        for chunk, rows in frame.sort_values(["_chunk", "opening"]).groupby("_chunk", sort=True):
            out.append((rows["key"].iloc[0], rows["_island"].iloc[0], chunk, start, count))
            later = rows[rows["opening"] >= start + micros]
            if len(later):
                start, count = int(later["start"].iloc[0]), int(later["count"].iloc[0])
        return pd.DataFrame(out, columns=["key", "_island", "_chunk", "_start", "_count"])

    return run


def admission_windows(events: DataFrame, limit: int, seconds: int, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """Judge ``events(key, event_id, ts)``: the first ``limit`` of a window are admitted, the rest are not counted.

    A window length without an event always ends a window, so the history of a key falls apart into islands of
    occupied time buckets that are judged independently.  A busy key may be one island: it is cut into chunks of whole buckets.
    In a bucket, which is as long as a window, at most one window opens, so a chunk turns the opening of its first window into its last
    one; these passages are composed along the island, and then all chunks are judged side by side from their own entry.
    """
    micros = seconds * 1_000_000
    timed = _timed(events).withColumn("_bucket", F.floor(F.col("micros") / micros))
    occupied = timed.groupBy("key", "_bucket").agg(F.count("*").alias("_n"))
    # one row per key and occupied bucket, not per event
    order = Window.partitionBy("key").orderBy("_bucket")
    islands = occupied.withColumn("_island", F.col("_bucket") - F.row_number().over(order))
    island = Window.partitionBy("key", "_island")
    before = F.coalesce(F.sum("_n").over(island.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunked = islands.withColumn("_chunk", F.floor(before / chunk_events)).withColumn("_chunks", F.max("_chunk").over(island))
    placed = timed.join(chunked.drop("_n"), ["key", "_bucket"])
    passages = placed.where("_chunks > 0").groupBy("key", "_island", "_chunk").applyInPandas(
        _passage(micros, limit), "key string, _island bigint, _chunk bigint, opening bigint, start bigint, count bigint")
    entries = passages.groupBy("key", "_island").applyInPandas(_entries(micros), "key string, _island bigint, _chunk bigint, _start bigint, _count bigint")
    chunk = ["key", "_island", "_chunk"]
    entered = placed.join(entries, chunk, "left").select(
        *chunk, "event_id", "micros", F.coalesce("_start", F.lit(NEVER)).alias("_start"), F.coalesce("_count", F.lit(0)).cast("bigint").alias("_count"))
    laid = entered.repartition(*chunk).sortWithinPartitions(*chunk, "micros", "event_id")
    judge = _judge(limit, micros)

    def run(frames):
        import pandas as pd

        current, start, count = None, None, 0
        for frame in frames:
            out = []
            for key, number, part, event, at, begun, held in zip(*(frame[c] for c in (*chunk, "event_id", "micros", "_start", "_count")), strict=True):
                if (key, number, part) != current:
                    current, start, count = (key, number, part), int(begun), int(held)
                start, count, admitted = judge(start, count, at)
                out.append((key, event, at, start, admitted))
            yield pd.DataFrame(out, columns=["key", "event_id", "micros", "window_start", "admitted"])

    return laid.mapInPandas(run, OUTPUT)


def stream_admission_windows(events: DataFrame, limit: int, seconds: int, late: str | None = LATE) -> DataFrame:
    """The same rule on a stream ``(key, event_id, ts)``; the open window of each key is its state.

    A window ends a fixed time after its first event, so when the watermark has passed that its state goes: a later event opens
    a window anyway.  Events more than ``late`` behind the latest are dropped; without it nothing is dropped and no state goes.
    """
    micros = seconds * 1_000_000
    judge = _judge(limit, micros)

    def step(key, rows, state):
        start, count = state or (None, 0)
        out = []
        rows = rows.sort_values(["micros", "event_id"])
        for event, at in zip(rows["event_id"], rows["micros"]):
            start, count, admitted = judge(start, count, at)
            out.append((key, event, at, start, admitted))
        return out, (start, count)

    timed = _timed(events).withColumn("at", F.timestamp_micros("micros"))
    return expiring(timed, "key", "at", late, step, OUTPUT, "start bigint, count bigint", None,
                    None if late is None else lambda state: -(-(state[0] + micros) // 1000))

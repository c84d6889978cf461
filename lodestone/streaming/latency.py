"""Stage times per window, on a table or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_latency(metrics: DataFrame, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Count, mean and 95th percentile of ``metrics(stage, ts, ms)`` per stage and window.

    On a stream, rows later than the delay are dropped and a window is emitted when the delay has passed it.
    The percentile is a sketch, so the state of a window is bounded.
    """
    timed = metrics.withColumn("ts", F.col("ts").cast("timestamp"))
    if metrics.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy("stage", F.window("ts", length).alias("w")).agg(
        F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.percentile_approx("ms", 0.95, 10000).alias("p95_ms")).select(
        "stage", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "avg_ms", "p95_ms")


def stage_sketches(metrics: DataFrame, length: str = "1 day", size: int = 1000) -> DataFrame:
    """``(stage, window_start, n, total_ms, sketch)``: what a window keeps of ``metrics(stage, ts, ms)``, some kilobytes whatever its rows.

    Kept as a table, a day is read once; any range is answered from its sketches.  Missing times are left out.
    """
    timed = metrics.where("ms is not null").select("stage", F.col("ts").cast("timestamp").alias("ts"), F.col("ms").cast("double").alias("ms"))
    return timed.groupBy("stage", F.window("ts", length).alias("w")).agg(
        F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.kll_sketch_agg_double("ms", size).alias("sketch")).select(
        "stage", F.col("w.start").alias("window_start"), "n", "total_ms", "sketch")


def merged_latency(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """``(stage, n, avg_ms, p50_ms, p95_ms)`` over the windows that start from ``since`` to before ``until``.

    Ranks are off by well under a hundredth of the rows at the default size, however many sketches are merged.
    """
    chosen = sketches
    if since is not None:
        chosen = chosen.where(F.col("window_start") >= F.lit(since))
    if until is not None:
        chosen = chosen.where(F.col("window_start") < F.lit(until))
    merged = chosen.groupBy("stage").agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("stage", "n", (F.col("total") / F.col("n")).alias("avg_ms"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms"))])

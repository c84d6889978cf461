"""Writing JSON lines, CSV details, run artifacts and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETAIL_COLUMNS = [
    "method", "normalized_method", "question_id", "question_type", "source_types", "expected_doc_ids",
    "top_parent_doc_ids", "latency_ms", "dedup_parent_results", "required_evidence_groups_count",
    "evidence_coverage", "reranker_used", "source_boost_applied",
]
DETAIL_METRICS = ["hit", "precision", "recall", "f1", "ndcg", "ap", "evidence_coverage", "matched_doc_ids"]


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per row; text stays text, nulls stay visible."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def details_table(details: DataFrame, ks: list[int]) -> DataFrame:
    """The CSV form of details: fixed column order, lists joined by a pipe, top ids cut to the largest k.

    Metric columns are named ``hit@5``; ``retrieved_parent_doc_ids`` is the ranked list.
    """
    top = F.slice("retrieved_parent_doc_ids", 1, max(ks))
    wide = details.withColumn("top_parent_doc_ids", top)
    names = DETAIL_COLUMNS + [f"{m}@{k}" for k in ks for m in DETAIL_METRICS] + [f"rr@{max(ks)}"]
    types = dict(wide.dtypes)
    return wide.select(*[
        F.array_join(F.col(f"`{n}`"), "|").alias(n) if types[n].startswith("array") else F.col(f"`{n}`") for n in names])


def write_details_csv(details: DataFrame, path: str, ks: list[int], mode: str = "error") -> None:
    details_table(details, ks).write.mode(mode).option("header", "true").csv(path)


def write_run_artifacts(folder: str, run_id: str, config: DataFrame, summary: DataFrame, details: DataFrame,
                        failures: DataFrame) -> None:
    """Four artifacts of one run, each a JSON table partitioned by run."""
    for name, rows in (("config", config), ("summary", summary), ("details", details), ("failures", failures)):
        rows.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").option(
            "ignoreNullFields", "false").json(f"{folder}/{name}")


def trace_date(time: str) -> Column:
    """The UTC date of a time, whatever zone the session is in."""
    return F.to_date(F.to_utc_timestamp(F.col(time), F.current_timezone()))


def append_traces(traces: DataFrame, folder: str, time: str = "created_at") -> None:
    """Append traces under the UTC date of their time."""
    dated = traces.withColumn("trace_date", trace_date(time))
    dated.write.partitionBy("trace_date").mode("append").parquet(folder)


def find_trace(spark: SparkSession, folder: str, debug_id: str) -> DataFrame:
    """The trace with this id, of the newest date that has it.

    Dates are tried from the newest on, each as one pruned scan, and older ones are not read once it is found.
    """
    traces = spark.read.parquet(folder)
    mine = traces.filter(F.col("debug_id") == debug_id)
    # the names of the partitions, not their rows
    for row in traces.select("trace_date").distinct().orderBy(F.desc("trace_date")).toLocalIterator():
        found = mine.filter(F.col("trace_date") == row["trace_date"])
        if not found.isEmpty():
            return found.orderBy("created_at").limit(1)
    return mine.limit(0)

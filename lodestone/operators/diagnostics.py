"""Stage times, citations, and the stage at which a question lost its gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ["dense_ms", "bm25_ms", "rrf_ms", "rerank_ms", "elapsed_ms"]


def stage_totals(attempts: DataFrame) -> DataFrame:
    """Attempts per request and the sums of their stage times; a missing time counts as 0."""
    return attempts.groupBy("request_id").agg(
        F.count("*").alias("attempts"),
        *[F.sum(F.coalesce(F.col(stage), F.lit(0.0))).alias(stage) for stage in STAGES])


def latency_percentiles(times: DataFrame, exact: bool = False) -> DataFrame:
    """Average, median and 95th percentile of ``times(stage, ms)``.

    The default sketches: its state is bounded however many rows one stage has.  ``exact`` counts equal
    values before it ranks them, so that its state grows with the distinct values of a stage only.
    """
    if exact:
        counted = times.groupBy("stage", "ms").agg(F.count("*").alias("n"))
        return counted.groupBy("stage").agg(
            (F.sum(F.col("ms") * F.col("n")) / F.sum("n")).alias("avg_ms"),
            F.percentile("ms", F.lit(0.5), F.col("n")).alias("p50_ms"),
            F.percentile("ms", F.lit(0.95), F.col("n")).alias("p95_ms"))
    return times.groupBy("stage").agg(
        F.avg("ms").alias("avg_ms"),
        F.percentile_approx("ms", 0.5, 10000).alias("p50_ms"),
        F.percentile_approx("ms", 0.95, 10000).alias("p95_ms"))


def citation_accuracy(questions: DataFrame, cited: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of questions with at least one cited item in their gold, per citation level.

    ``cited`` and ``gold`` are ``(level, question_id, item_id)`` with level doc or chunk.
    """
    right = cited.join(gold, ["level", "question_id", "item_id"], "left_semi").select("level", "question_id").distinct()
    levels = F.explode(F.array(F.lit("doc"), F.lit("chunk")))
    asked = questions.select("question_id", levels.alias("level"))
    marked = asked.join(right.withColumn("right", F.lit(1)), ["level", "question_id"], "left")
    return marked.groupBy("level").agg(
        F.count("*").alias("questions"), F.avg(F.coalesce("right", F.lit(0))).alias("accuracy"))


def _reached(rows: DataFrame, gold: DataFrame, name: str, max_rank: int | None = None) -> DataFrame:
    if max_rank is not None:
        rows = rows.filter(F.col("rank") <= max_rank)
    return rows.join(gold, ["question_id", "item_id"], "left_semi").select("question_id").distinct().withColumn(
        name, F.lit(True))


def attribute_failures(questions: DataFrame, gold: DataFrame, dense: DataFrame, bm25: DataFrame,
                       fused: DataFrame, reranked: DataFrame, sources: DataFrame,
                       coverage: DataFrame | None = None) -> DataFrame:
    """The first stage that lost the gold of each question that has gold.

    The stage relations are ``(question_id, item_id, rank)``.  ``coverage(question_id, n_groups, found_groups,
    kept_groups)`` adds the two reasons of decomposed questions: what all sub-queries found, what was kept.
    """
    gold = gold.select("question_id", "item_id").distinct()
    table = questions.select("question_id").join(gold.select("question_id").distinct(), "question_id", "left_semi")
    for name, rows, cut in (("in_dense", dense, None), ("in_bm25", bm25, None), ("in_fused", fused, None),
                            ("top_reranked", reranked, 1), ("in_reranked", reranked, None), ("in_sources", sources, None)):
        table = table.join(_reached(rows, gold, name, cut), "question_id", "left")
    flags = ["in_dense", "in_bm25", "in_fused", "top_reranked", "in_reranked", "in_sources"]
    table = table.select("question_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])

    def flag(name: str) -> Column:
        return F.col(name)

    reason = (F.when(~flag("in_dense") & ~flag("in_bm25"), "missed_all_gold")
              .when((flag("in_dense") | flag("in_bm25")) & ~flag("in_fused"), "fusion_dropped_gold"))
    if coverage is not None:
        table = table.join(coverage, "question_id", "left")
        reason = (reason.when(F.col("found_groups") < F.col("n_groups"), "decompose_partial_evidence")
                  .when(F.col("kept_groups") < F.col("found_groups"), "decompose_merge_dropped_group"))
    reason = (reason.when(flag("in_fused") & ~flag("in_reranked"), "context_budget_dropped_gold")
              .when(~flag("in_sources"), "citation_not_gold")
              .when(~flag("top_reranked"), "reranker_top1_not_gold")
              .when(~flag("in_dense"), "dense_missed_bm25_hit")
              .when(~flag("in_bm25"), "bm25_missed_dense_hit"))
    return table.withColumn("failure_type", reason).filter("failure_type IS NOT NULL").select(
        "question_id", "failure_type")

"""Sub-queries: validated plans, expanded and rewritten questions, merged rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import strip
from lodestone.operators.ranking import with_rank

SUB_QUERY = "struct<id:variant,query:variant,purpose:variant,depends_on:variant>"


def _has_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def validate_sub_query_plans(plans: DataFrame, raw: str = "raw") -> DataFrame:
    """Check planner replies ``(plan_id, raw)``: valid plans give a row per sub-query, others one row with
    the reason.  Ids, queries and dependencies are trimmed."""
    parsed = plans.withColumn("_json", F.try_parse_json(F.col(raw)))
    listed = parsed.withColumn("_items", F.when(
        F.schema_of_variant(F.try_variant_get("_json", "$.sub_queries", "variant")).startswith("ARRAY"),
        F.try_variant_get("_json", "$.sub_queries", "array<variant>")))

    def text(item: Column, name: str) -> Column:
        value = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(_has_text(value), strip(F.try_variant_get(value, "$", "string")))

    def dependencies(item: Column) -> Column:
        value = F.try_variant_get(item, "$.depends_on", "variant")
        given = F.try_variant_get(value, "$", "array<variant>")
        texts = F.transform(given, lambda d: F.when(_has_text(d), strip(F.try_variant_get(d, "$", "string"))))
        missing = F.array().cast("array<string>")
        return F.when(value.isNull(), missing).otherwise(texts)

    items = listed.withColumn("_subs", F.transform("_items", lambda item: F.struct(
        text(item, "id").alias("id"), text(item, "query").alias("query"),
        F.try_variant_get(item, "$.purpose", "string").alias("purpose"),
        dependencies(item).alias("depends_on"))))
    subs = F.col("_subs")
    ids = F.transform(subs, lambda s: s["id"])
    queries = F.transform(subs, lambda s: s["query"])
    well_formed = F.forall(subs, lambda s: F.coalesce(
        (s["id"] != "") & (s["query"] != "") & s["purpose"].isin(model.SUB_QUERY_PURPOSES)
        & s["depends_on"].isNotNull()
        & F.forall(s["depends_on"], lambda d: F.coalesce(d != "", F.lit(False))), F.lit(False)))
    distinct = (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_distinct(queries)) == F.size(queries))
    used = F.flatten(F.transform(subs, lambda s: s["depends_on"]))
    resolved = F.size(F.array_except(used, ids)) == 0
    fine = F.coalesce(well_formed & distinct & resolved, F.lit(False))
    reason = (F.when(F.col("_json").isNull(), "invalid_json")
              .when(F.col("_items").isNull(), "invalid_json_shape")
              .when(~F.size("_items").between(2, 4), "invalid_sub_query_count")
              .when(~fine, "invalid_sub_query_content"))
    judged = items.withColumn("reason", reason)
    keep = [c for c in plans.columns if c != raw]
    valid = judged.withColumn("_shown", F.when(F.col("reason").isNull(), subs))
    return valid.select(*keep, "reason", F.posexplode_outer("_shown").alias("position", "s")).select(
        *keep, "reason", "position", F.col("s.id").alias("sub_query_id"), "s.query", "s.purpose", "s.depends_on")


def expand_queries(questions: DataFrame, max_facts: int | None = None) -> DataFrame:
    """``(query_id, sub_query_id, query)``: the facts of a decomposed question, or the first ``max_facts``, else itself."""
    facts = F.filter(F.transform(F.coalesce("answer_facts", F.array().cast("array<string>")), strip), lambda f: f != "")
    use_facts = F.col("question_type").isin(model.DECOMPOSED_TYPES) & (F.size(facts) > 0)
    parts = F.when(use_facts, facts if max_facts is None else F.slice(facts, 1, max_facts)).otherwise(F.array("query"))
    keep = [c for c in questions.columns if c not in ("query", "answer_facts")]
    return questions.select(*keep, F.posexplode(parts).alias("position", "query")).withColumn(
        "sub_query_id", F.concat(F.lit("sq"), F.col("position") + 1)).drop("position")


def rewrite_queries(questions: DataFrame) -> DataFrame:
    """The question, its source hints and a fixed suffix."""
    hints = F.array_join(F.coalesce("source_hints", F.array().cast("array<string>")), " ")
    return questions.withColumn("query", strip(F.concat(
        F.col("query"), F.lit(" "), hints, F.lit(" " + model.REWRITE_SUFFIX))))


def substitute_queries(questions: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """Search with a supplied hypothetical text where there is one."""
    given = hypothetical.select("query_id", F.nullif("text", F.lit("")).alias("_text"))
    return questions.join(given, "query_id", "left").withColumn(
        "query", F.coalesce("_text", "query")).drop("_text")


def merge_subqueries_best(ranked: DataFrame) -> DataFrame:
    """Per question and chunk the best score over the sub-queries, ranked again; blank ids dropped."""
    known = ranked.filter(F.coalesce("item_id", F.lit("")) != "")
    best = known.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return with_rank(best, [F.col("score").desc(), F.col("item_id")])


def merge_subqueries_coverage(ranked: DataFrame, sub_queries: DataFrame, weight: float = model.COVERAGE_WEIGHT) -> DataFrame:
    """Best score, raised with the share of the question's sub-queries that found the item.

    ``ranked(query_id, sub_query_id, item_id, score, rank)``; a score of 0 counts as 1 / rank.
    """
    counts = sub_queries.groupBy("query_id").agg(F.count_distinct("sub_query_id").alias("n_sub_queries"))
    scored = ranked.withColumn("_score", F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col("score")).otherwise(1 / F.col("rank")))
    # at most one entry per sub-query of the question, of which a plan has four
    merged = scored.groupBy("query_id", "item_id").agg(
        F.max("_score").alias("fused_score"), F.array_sort(F.collect_set("sub_query_id")).alias("matched_sub_query_ids"))
    covered = merged.join(counts, "query_id", "left").withColumn(
        "coverage_score", F.size("matched_sub_query_ids") / F.greatest(F.coalesce("n_sub_queries", F.lit(1)), F.lit(1)))
    final = covered.withColumn("score", F.round(F.col("fused_score") * (1 + weight * F.col("coverage_score")), 9))
    return with_rank(final, [F.col("score").desc(), F.col("item_id")]).drop("n_sub_queries")

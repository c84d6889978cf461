"""Judge scores, final contexts of answers, and memory evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import strip
from lodestone.functions.tokens import terms_hit
from lodestone.operators.ranking import keep_first, with_rank


def _given(column: str) -> Column:
    return F.nullif(strip(F.coalesce(F.col(column), F.lit(""))), F.lit(""))


def final_documents(selected: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents an answer cites, in the order of its sources, each once.

    ``selected(question_id, doc_order, source_id, parent_chunk_id, parent_doc_id, ...)`` are the documents of
    all attempts; ``sources(question_id, source_order, parent_chunk_id, source_id, parent_doc_id)``.  A source
    matches by chunk id, else by source id; by document id only where it has neither.
    """
    exact = selected.select("question_id", "doc_order", F.explode(F.array_distinct(F.array_compact(
        F.array(_given("parent_chunk_id"), _given("source_id"))))).alias("key"))
    by_exact = keep_first(exact, ["question_id", "key"], [F.col("doc_order")])
    by_doc = keep_first(
        selected.select("question_id", "doc_order", _given("parent_doc_id").alias("key")).filter("key IS NOT NULL"),
        ["question_id", "key"], [F.col("doc_order")])
    wanted = sources.select("question_id", "source_order", _given("parent_chunk_id").alias("chunk_key"),
                            _given("source_id").alias("source_key"), _given("parent_doc_id").alias("doc_key"))

    def lookup(table: DataFrame, key: str, found: str) -> DataFrame:
        return table.select("question_id", F.col("key").alias(key), F.col("doc_order").alias(found))

    matched = (wanted
               .join(lookup(by_exact, "chunk_key", "by_chunk"), ["question_id", "chunk_key"], "left")
               .join(lookup(by_exact, "source_key", "by_source"), ["question_id", "source_key"], "left")
               .join(lookup(by_doc, "doc_key", "by_doc"), ["question_id", "doc_key"], "left"))
    no_exact_id = F.col("chunk_key").isNull() & F.col("source_key").isNull()
    chosen = matched.select("question_id", "source_order", F.coalesce(
        "by_chunk", "by_source", F.when(no_exact_id, F.col("by_doc"))).alias("doc_order"))
    once = chosen.filter("doc_order IS NOT NULL").groupBy("question_id", "doc_order").agg(
        F.min("source_order").alias("source_order"))
    return once.join(selected, ["question_id", "doc_order"])


def final_contexts(selected: DataFrame, sources: DataFrame) -> DataFrame:
    """``(question_id, position, context)``: the distinct non-blank texts of the cited documents, in order."""
    texts = final_documents(selected, sources).select(
        "question_id", "source_order", F.coalesce(_given("text"), _given("child_text")).alias("context"))
    once = texts.filter("context IS NOT NULL").groupBy("question_id", "context").agg(
        F.min("source_order").alias("source_order"))
    return with_rank(once, [F.col("source_order")], "question_id", "position").select(
        "question_id", "position", "context")


def attach_judge_scores(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Join ``scores(question_id, scores map<string,string>)`` to answers that were generated.

    Values that are no numbers are dropped.  ``judge_error`` says what is missing.
    """
    numeric = F.map_filter(F.transform_values("scores", lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    judged = scores.select("question_id", numeric.alias("judge_scores"), F.lit(True).alias("judged"))
    joined = records.join(judged, "question_id", "left")
    wanted = F.array(*[F.lit(m) for m in model.JUDGE_METRICS])
    missing = F.array_except(wanted, F.map_keys("judge_scores"))
    error = (F.when(F.coalesce("generation_error", F.lit("")) != "", None)
             .when(F.col("judged").isNull(), "RAGAS returned fewer results than samples")
             .when(F.size("judge_scores") == 0, "RAGAS returned no numeric scores")
             .when(F.size(missing) > 0, F.concat(F.lit("RAGAS missing metrics: "), F.array_join(missing, ", "))))
    skipped = (F.coalesce("generation_error", F.lit("")) != "") | F.col("judged").isNull() | (F.size("judge_scores") == 0)
    return (joined.withColumn("judge_error", error)
            .withColumn("judge_scores", F.when(~skipped, F.col("judge_scores"))).drop("judged"))


def judge_summary(records: DataFrame, intended: int | None = None) -> DataFrame:
    """``(metric, value, coverage, coverage_rate)`` per judge metric, with the run's totals beside them."""
    metrics = model.JUDGE_METRICS
    has_all = F.lit(True)
    for name in metrics:
        has_all = has_all & F.col("judge_scores")[name].isNotNull()
    has_all = F.coalesce(has_all, F.lit(False))
    failed = (F.coalesce("generation_error", F.lit("")) != "") | F.col("judge_error").isNotNull() | ~has_all
    sums = []
    for name in metrics:
        value = F.col("judge_scores")[name]
        sums += [F.round(F.avg(value), 4).alias(f"mean_{name}"), F.count(value).alias(f"n_{name}")]
    totals = records.agg(
        F.count("*").alias("questions"), F.count_if(has_all).alias("valid"), F.count_if(failed).alias("failures"),
        F.coalesce(F.round(F.avg("latency_ms"), 4), F.lit(0.0)).alias("average_latency_ms"), *sums)
    n_intended = F.col("questions") if intended is None else F.lit(intended).cast("bigint")
    ratio = F.when(n_intended > 0, F.col("valid") / n_intended).otherwise(1.0)
    rows = F.array(*[F.struct(
        F.lit(name).alias("metric"), F.col(f"mean_{name}").alias("value"), F.col(f"n_{name}").alias("coverage"),
        F.round(F.col(f"n_{name}") / F.greatest(n_intended, F.lit(1)), 4).alias("coverage_rate"))
        for name in metrics])
    return totals.select("questions", n_intended.alias("intended"), "valid", "failures", "average_latency_ms",
                         F.when(ratio >= 0.8, "complete").otherwise("incomplete").alias("status"),
                         F.explode(rows).alias("m")).select(
        "questions", "intended", "valid", "failures", "average_latency_ms", "status", "m.*")


def memory_case_results(cases: DataFrame, retrieved: DataFrame, answers: DataFrame, after_delete: DataFrame,
                        other_user: DataFrame | None = None) -> DataFrame:
    """Pass flags of every memory case; ``null`` where a check does not apply.

    ``retrieved``, ``after_delete`` and ``other_user`` are ``(case_id, memory)``, ``answers`` ``(case_id, answer)``.
    """
    def hit(memories: DataFrame, name: str) -> DataFrame:
        checked = memories.join(cases.select("case_id", "expected_memory_terms"), "case_id")
        return checked.groupBy("case_id").agg(
            F.bool_or(terms_hit(F.col("memory"), F.col("expected_memory_terms"))).alias(name))

    table = (cases.join(hit(retrieved, "found"), "case_id", "left").join(answers, "case_id", "left")
             .join(hit(after_delete, "still_there"), "case_id", "left"))
    isolation = F.lit(None).cast("boolean")
    if other_user is not None:
        table = table.join(hit(other_user, "leaked"), "case_id", "left")
        isolation = ~F.coalesce("leaked", F.lit(False))
    search = F.coalesce("found", F.lit(False))
    answered = terms_hit(F.coalesce("answer", F.lit("")), F.col("expected_answer_terms"))
    deleted = F.when(F.col("delete_after"), search & ~F.coalesce("still_there", F.lit(False)))
    flagged = table.select("case_id", "category", "delete_after", search.alias("search_pass"),
                           answered.alias("answer_pass"), deleted.alias("delete_pass"),
                           isolation.alias("isolation_pass"))
    passed = (F.col("search_pass") & F.col("answer_pass") & F.coalesce("delete_pass", F.lit(True))
              & F.coalesce("isolation_pass", F.lit(True)))
    return flagged.withColumn("passed", passed)


def memory_eval_summary(results: DataFrame) -> DataFrame:
    """Rates over all cases; deletion and isolation over the cases they apply to, null if none."""
    def rate(flag: str) -> Column:
        return F.round(F.avg(F.col(flag).cast("int")), 4)

    return results.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"),
        F.coalesce(rate("passed"), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(rate("search_pass"), F.lit(0.0)).alias("memory_search_hit_rate"),
        F.coalesce(rate("answer_pass"), F.lit(0.0)).alias("answer_hit_rate"),
        F.round(F.avg(F.when(F.col("delete_after"), F.coalesce("delete_pass", F.lit(False)).cast("int"))), 4)
        .alias("delete_pass_rate"),
        rate("isolation_pass").alias("isolation_pass_rate"))

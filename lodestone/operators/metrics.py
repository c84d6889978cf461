"""Ranking metrics for all questions at once.

Inputs are tall: ``questions(question_id, ...)``, ``ranked(question_id, item_id, rank)`` and
``gold(question_id, item_id)``.  Only the first max(k) rows of a ranking are shuffled, and only the gold
hits among them reach the final aggregation, so neither long rankings nor hot questions grow a task.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from lodestone.session import stack

METRICS = ["hit", "precision", "recall", "f1", "rr", "ap", "ndcg"]


def top_ranked(ranked: DataFrame, max_k: int) -> DataFrame:
    """Blank ids leave the list before it is cut; the rest closes up."""
    filled = ranked.filter(F.coalesce(F.col("item_id"), F.lit("")) != "")
    order = Window.partitionBy("question_id").orderBy("rank", "item_id")
    return (filled.select("question_id", "item_id", "rank")
            .withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= max_k)
            .select("question_id", "item_id", F.col("position").alias("rank")))


def gold_hits(ranked: DataFrame, gold: DataFrame, max_k: int) -> DataFrame:
    """``(question_id, item_id, rank, hit_no)``: gold items where they are first seen."""
    first_seen = (top_ranked(ranked, max_k)
                  .join(gold.select("question_id", "item_id").distinct(), ["question_id", "item_id"])
                  .groupBy("question_id", "item_id").agg(F.min("rank").alias("rank")))
    return first_seen.withColumn(
        "hit_no", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def expected_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("question_id").agg(F.count_distinct("item_id").alias("n_expected"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def stable(value: Column) -> Column:
    """Sums of floats depend on their order in the last digits; thresholds must not."""
    return F.round(value, 12)


def question_metrics(questions: DataFrame, ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """One row per question and k with all rank metrics; questions without gold or candidates score 0."""
    ks = sorted(set(ks))
    if not ks or ks[0] <= 0:
        raise ValueError("k values must be positive")
    hits = gold_hits(ranked, gold, ks[-1])
    rank, hit_no = F.col("rank"), F.col("hit_no")

    # gains come from a table of constants: the JVM's log2 is not exact at powers of two
    gains = [1 / log2(position + 1) for position in range(1, ks[-1] + 1)]
    gain = F.get(F.lit(gains), rank - 1)

    def upto(k: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(rank <= k, value)), F.lit(0.0))

    sums = [F.min("rank").alias("first_rank")]
    for k in ks:
        sums += [F.count_if(rank <= k).alias(f"n_{k}"), upto(k, hit_no / rank).alias(f"ap_{k}"),
                 upto(k, gain).alias(f"dcg_{k}")]
    per_question = (questions.select("question_id")
                    .join(expected_counts(gold), "question_id", "left")
                    .join(hits.groupBy("question_id").agg(*sums), "question_id", "left")
                    .withColumn("n_expected", F.coalesce("n_expected", F.lit(0))))
    ideal_gain = F.lit([sum(gains[:n]) for n in range(ks[-1] + 1)])
    rows = []
    for k in ks:
        n_hits = F.coalesce(F.col(f"n_{k}"), F.lit(0))
        best = F.least(F.col("n_expected"), F.lit(k))
        has_gold = F.col("n_expected") > 0
        precision = n_hits / F.lit(k)
        recall = F.when(has_gold, n_hits / F.col("n_expected")).otherwise(0.0)
        rows.append(F.struct(
            F.lit(k).alias("k"), n_hits.alias("n_hits"),
            (n_hits > 0).cast("int").alias("hit"), precision.alias("precision"), recall.alias("recall"),
            f1(precision, recall).alias("f1"),
            F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0).alias("rr"),
            stable(F.when(has_gold, F.coalesce(F.col(f"ap_{k}"), F.lit(0.0)) / best).otherwise(0.0)).alias("ap"),
            stable(F.when(has_gold, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0))
                   / F.get(ideal_gain, best.cast("int"))).otherwise(0.0)).alias("ndcg"),
        ))
    return per_question.select(
        "question_id", "n_expected", F.explode(F.array(*rows)).alias("m")).select(
        "question_id", "n_expected", "m.*")


def _one_metric(name: str, doc: str):
    def metric(questions: DataFrame, ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
        return question_metrics(questions, ranked, gold, ks).select("question_id", "k", name)

    metric.__name__ = f"{name}_at_k"
    metric.__doc__ = doc
    return metric


hit_at_k = _one_metric("hit", "1 where any gold item is among the first k.")
precision_at_k = _one_metric("precision", "Distinct gold items among the first k, divided by k.")
recall_at_k = _one_metric("recall", "Distinct gold items among the first k, divided by all gold items.")
f1_at_k = _one_metric("f1", "Harmonic mean of precision and recall.")
rr_at_k = _one_metric("rr", "1 / rank of the first gold item.")
ap_at_k = _one_metric("ap", "Mean of hits so far / rank over first-seen hits, of min(gold, k).")
ndcg_at_k = _one_metric("ndcg", "Binary gain, discounted by log2, of the ideal order.")


def evidence_coverage_at_k(questions: DataFrame, evidence: DataFrame, groups: DataFrame, ks: list[int]) -> DataFrame:
    """Share of a question's evidence groups with any id among the evidence of the first k hits.

    ``evidence(question_id, rank, evidence_ids array)``, ``groups(question_id, group_id, evidence_id)``.
    """
    top = evidence.filter(F.col("rank") <= max(ks)).select(
        "question_id", "rank", F.explode("evidence_ids").alias("evidence_id"))
    reached = (groups.join(top.filter("evidence_id <> ''"), ["question_id", "evidence_id"])
               .groupBy("question_id", "group_id").agg(F.min("rank").alias("rank"))
               .groupBy("question_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"c_{k}") for k in ks]))
    required = groups.groupBy("question_id").agg(F.count_distinct("group_id").alias("n_groups"))
    joined = (questions.select("question_id").join(required, "question_id", "left")
              .join(reached, "question_id", "left"))
    n_groups = F.coalesce("n_groups", F.lit(0))
    rows = [F.struct(F.lit(k).alias("k"),
                     F.when(n_groups > 0, F.coalesce(F.col(f"c_{k}"), F.lit(0)) / n_groups)
                     .otherwise(0.0).alias("evidence_coverage")) for k in ks]
    return joined.select("question_id", n_groups.alias("n_groups"), F.explode(F.array(*rows)).alias("m")).select(
        "question_id", "n_groups", "m.*")


def chunk_level_metrics(questions: DataFrame, ranked_chunks: DataFrame, gold_docs: DataFrame,
                        gold_chunks: DataFrame, ks: list[int]) -> DataFrame:
    """hit, precision and recall on chunk gold and, chunks mapped to their documents, on document gold.

    ``ranked_chunks(question_id, chunk_id, doc_id, rank)``.
    """
    def level(name: str, column: str, gold: DataFrame) -> DataFrame:
        ranked = ranked_chunks.select("question_id", F.col(column).alias("item_id"), "rank")
        if name == "doc":
            ranked = first_per_item(ranked)
        return question_metrics(questions, ranked, gold, ks).select(
            F.lit(name).alias("level"), "question_id", "k", "hit", "precision", "recall")

    return level("chunk", "chunk_id", gold_chunks).transform(stack, level("doc", "doc_id", gold_docs))


def first_per_item(ranked: DataFrame) -> DataFrame:
    """Keep the first rank of each item of a question and close up."""
    best = ranked.groupBy("question_id", "item_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("question_id").orderBy("rank", "item_id")
    return best.withColumn("rank", F.row_number().over(order))

"""Orders after a reranker, and the chunk lists that evidence coverage reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import with_rank
from lodestone.session import stack


def rerank_pairs(ranked: DataFrame, texts: DataFrame, questions: DataFrame, window: int, max_chars: int | None = None) -> DataFrame:
    """``(query_id, item_id, query, text)`` of the first rows of each ranking, text cut to ``max_chars`` if given."""
    text = F.coalesce("text", F.lit(""))
    head = ranked.filter(F.col("rank") <= window).select("query_id", "item_id")
    return head.join(texts.select("item_id", "text"), "item_id", "left").join(
        questions.select("query_id", "query"), "query_id").select(
        "query_id", "item_id", "query", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"))


def rerank_window(ranked: DataFrame, scores: DataFrame, window: int) -> DataFrame:
    """Reorder the first rows by model score; the tail keeps its order and place."""
    scored = ranked.join(scores.select("query_id", "item_id", F.col("score").alias("reranker_score")),
                         ["query_id", "item_id"], "left")
    inside = F.col("rank") <= window
    order = [inside.desc(), F.when(inside, F.coalesce("reranker_score", F.lit(0.0))).desc(), F.col("rank"), F.col("item_id")]
    return with_rank(scored, order, name="_new").withColumn("rank", F.col("_new")).drop("_new")


def rerank_all(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by model score; rows without one are dropped, a query without any keeps its order."""
    known = scores.filter("score IS NOT NULL")
    answered = known.select("query_id").distinct().withColumn("_answered", F.lit(True))
    scored = (ranked.join(known.select("query_id", "item_id", F.col("score").alias("reranker_score")), ["query_id", "item_id"], "left")
              .join(answered, "query_id", "left")
              .filter("_answered IS NULL OR reranker_score IS NOT NULL"))
    order = [F.col("reranker_score").desc_nulls_last(), F.col("rank"), F.col("item_id")]
    return with_rank(scored, order, name="_new").withColumn("rank", F.col("_new")).drop("_new", "_answered")


def coverage_order(ranked: DataFrame, documents: DataFrame, reranked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(query_id, item_id, rank)``: the chunk list whose evidence counts, with the columns to ``keep`` of both relations.

    Without a reranker it is the ranking itself.  For the queries in ``reranked`` it is the reranked
    representatives, then the other chunks of the ranked documents in their old order.
    """
    kept = keep or []
    chunks = ranked.filter("item_id <> ''").select("query_id", "item_id", "parent_doc_id", "rank", *kept)
    plain = chunks.join(reranked.select("query_id"), "query_id", "left_anti").select("query_id", "item_id", "rank", *kept)
    heads = documents.join(reranked.select("query_id"), "query_id", "left_semi")
    siblings = chunks.filter("parent_doc_id <> ''").join(
        heads.select("query_id", "parent_doc_id"), ["query_id", "parent_doc_id"], "left_semi")
    phased = heads.filter("item_id <> ''").select("query_id", "item_id", *kept, F.struct(F.lit(0).alias("p"), "rank").alias("place")).transform(stack, 
        siblings.select("query_id", "item_id", *kept, F.struct(F.lit(1).alias("p"), "rank").alias("place")))
    once = phased.groupBy("query_id", "item_id").agg(F.min("place").alias("place"), *[F.min_by(c, "place").alias(c) for c in kept])
    ordered = with_rank(once, [F.col("place"), F.col("item_id")]).select("query_id", "item_id", "rank", *kept)
    return plain.transform(stack, ordered)

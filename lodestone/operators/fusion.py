"""Fusing ranked lists.  Lists are unioned and aggregated: one shuffle by (query, item), no outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import model
from lodestone.operators.ranking import with_rank
from lodestone.session import stack


def collapse_to_parent(ranked: DataFrame, rerank: bool = True) -> DataFrame:
    """The best child of each parent chunk; ranks close up, or stay those of the children.

    ``ranked(query_id, item_id, parent_chunk_id, rank)`` → ``(query_id, parent_chunk_id, item_id, rank)``.
    """
    known = ranked.filter(F.coalesce("parent_chunk_id", F.lit("")) != "")
    best = known.groupBy("query_id", "parent_chunk_id").agg(
        F.min_by("item_id", F.struct("rank", "item_id")).alias("item_id"), F.min("rank").alias("rank"))
    if not rerank:
        return best
    return with_rank(best, [F.col("rank"), F.col("item_id")], name="_dense").withColumn("rank", F.col("_dense")).drop("_dense")


def _union(lists: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    marked = [rows.select(*columns).withColumn("channel", F.lit(name)) for name, rows in lists.items()]
    return reduce(stack, marked)


def rrf_fuse(lists: dict[str, DataFrame], k: int = model.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the channels; an item listed twice counts with its first rank.

    Ranks are positions in their lists, so a repeat leaves a gap and blank ids keep their place.
    """
    known = _union(lists, ["query_id", "item_id", "rank"]).filter(F.coalesce("item_id", F.lit("")) != "")
    first = known.groupBy("query_id", "item_id", "channel").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return with_rank(fused, [F.col("score").desc(), F.col("item_id")])


def rrf_fuse_children(vector: DataFrame, bm25: DataFrame, k: int = model.RRF_K) -> DataFrame:
    """Fuse two child rankings and keep each channel's rank and score."""
    rows = _union({"vector": vector, "bm25": bm25}, ["query_id", "item_id", "rank", "score"])

    def of(channel: str, column: str) -> Column:
        return F.min_by(F.when(F.col("channel") == channel, F.col(column)),
                        F.when(F.col("channel") == channel, F.col("rank")))

    wide = rows.groupBy("query_id", "item_id").agg(
        of("vector", "rank").alias("vector_rank"), of("vector", "score").alias("vector_score"),
        of("bm25", "rank").alias("bm25_rank"), of("bm25", "score").alias("bm25_score"))
    share = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("vector_rank", "bm25_rank")]
    return wide.withColumn("fused_score", F.round(share[0] + share[1], 9))


def rrf_fuse_graph(children: DataFrame, graph: DataFrame, k: int = model.RRF_K) -> DataFrame:
    """Add graph hits to fused children: a hit raises the best child of its parent or enters as itself.

    ``children``: rrf_fuse_children with parent_chunk_id and doc_semantic_type.  ``graph(query_id, item_id,
    parent_chunk_id, doc_semantic_type, rank, score, evidence_ids)``.  A generic type is filled from the hit,
    evidence ids are united.
    """
    def key(rows: DataFrame) -> Column:
        return F.coalesce(F.nullif("parent_chunk_id", F.lit("")), F.col("item_id"))

    none = F.lit(None)
    left = children.select(
        "query_id", key(children).alias("_key"), "item_id", "parent_chunk_id", "doc_semantic_type", "vector_rank",
        "vector_score", "bm25_rank", "bm25_score", "fused_score", F.lit(False).alias("_from_graph"),
        none.cast("int").alias("graph_rank"), none.cast("double").alias("graph_score"),
        F.array().cast("array<string>").alias("evidence_ids"))
    evidence = F.array_distinct(F.filter(F.concat(
        F.array("item_id", "parent_chunk_id"), F.coalesce("evidence_ids", F.array().cast("array<string>"))),
        lambda e: e.isNotNull() & (e != "")))
    right = graph.select(
        "query_id", key(graph).alias("_key"), key(graph).alias("item_id"), "parent_chunk_id", "doc_semantic_type",
        none.cast("int").alias("vector_rank"), none.cast("double").alias("vector_score"),
        none.cast("int").alias("bm25_rank"), none.cast("double").alias("bm25_score"),
        F.lit(0.0).alias("fused_score"), F.lit(True).alias("_from_graph"),
        F.col("rank").cast("int").alias("graph_rank"), F.col("score").alias("graph_score"), evidence.alias("evidence_ids"))
    both = left.transform(stack, right)
    # one parent of one query: its few children and at most one hit
    parent = Window.partitionBy("query_id", "_key")
    best_rank = F.least(F.coalesce("vector_rank", F.lit(2**31 - 1)), F.coalesce("bm25_rank", F.lit(2**31 - 1)))
    placed = both.withColumn("_place", F.row_number().over(parent.orderBy(
        F.col("_from_graph"), F.col("fused_score").desc(), best_rank, F.col("item_id"))))
    hit = F.max(F.when(F.col("_from_graph"), F.struct(
        "graph_rank", "graph_score", "evidence_ids", F.col("doc_semantic_type").alias("kind")))).over(parent)
    met = placed.withColumn("_hit", F.when(F.col("_place") == 1, hit)).filter(~F.col("_from_graph") | (F.col("_place") == 1))
    generic = F.coalesce("doc_semantic_type", F.lit("")).isin("", "generic_doc")
    kind = F.when(generic, F.coalesce(F.nullif("_hit.kind", F.lit("")), F.lit("generic_doc"))).otherwise(F.col("doc_semantic_type"))
    return met.select(
        "query_id", "item_id", "parent_chunk_id", kind.alias("doc_semantic_type"), "vector_rank", "vector_score",
        "bm25_rank", "bm25_score", F.col("_hit.graph_rank").alias("graph_rank"), F.col("_hit.graph_score").alias("graph_score"),
        F.coalesce("_hit.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.round(F.col("fused_score") + F.coalesce(1.0 / (k + F.col("_hit.graph_rank")), F.lit(0.0)), 9).alias("fused_score"))


def ensemble_weights(query: Column) -> tuple[Column, Column]:
    """Weights of the vector and BM25 lists by length and word density of the query."""
    length = F.length(query)
    n_words = F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""))
    vector = F.when(length > 50, 0.7).when(length < 20, 0.3).otherwise(0.5)
    bm25 = F.when(length > 50, 0.3).when(length < 20, 0.7).otherwise(0.5)
    dense = (n_words > 0) & (n_words / length > 0.1)
    empty = F.coalesce(query, F.lit("")) == ""
    return (F.when(empty, 0.5).when(dense, F.greatest(vector - 0.1, F.lit(0.3))).otherwise(vector),
            F.when(empty, 0.5).when(dense, F.least(bm25 + 0.1, F.lit(0.7))).otherwise(bm25))


def weighted_ensemble(vector: DataFrame, bm25: DataFrame, questions: DataFrame, k: int = model.RRF_K) -> DataFrame:
    """Weighted reciprocal ranks, the weights chosen by each query's text."""
    to_vector, to_bm25 = ensemble_weights(F.col("query"))
    weights = questions.select("query_id", to_vector.alias("_vector"), to_bm25.alias("_bm25"))
    rows = _union({"vector": vector, "bm25": bm25}, ["query_id", "item_id", "rank"])
    first = rows.groupBy("query_id", "item_id", "channel").agg(F.min("rank").alias("rank")).join(weights, "query_id")
    weight = F.when(F.col("channel") == "vector", F.col("_vector")).otherwise(F.col("_bm25"))
    fused = first.groupBy("query_id", "item_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"))
    return with_rank(fused, [F.col("score").desc(), F.col("item_id")])


def top_k(ranked: DataFrame, limits: DataFrame, column: str, max_k: int) -> DataFrame:
    """Cut each query at its own k.  The literal maximum comes first: it is the cut Spark can push."""
    cut = ranked.filter(F.col("rank") <= max_k)
    return cut.join(limits.select("query_id", F.col(column).alias("_k")), "query_id").filter(
        F.col("rank") <= F.col("_k")).drop("_k")


def dedup_docs(ranked: DataFrame) -> DataFrame:
    """First hit per document, ranks closed up; the rank of its chunk is kept as ``raw_child_rank``."""
    known = ranked.filter(F.coalesce("parent_doc_id", F.lit("")) != "")
    whole = F.struct(*[c for c in known.columns if c not in ("query_id", "parent_doc_id")])
    first = known.groupBy("query_id", "parent_doc_id").agg(F.min_by(whole, F.struct("rank", "item_id")).alias("hit"))
    flat = first.select("query_id", "parent_doc_id", "hit.*").withColumnRenamed("rank", "raw_child_rank")
    return with_rank(flat, [F.col("raw_child_rank"), F.col("item_id")])

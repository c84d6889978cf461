"""Retrieval for whole question sets: the methods, and the passes of a retry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.rules import broaden, evidence_check, next_action
from lodestone.operators import filters, fusion, graph as graphs, lexical, rerank, subqueries
from lodestone.operators.dense import knn_exact
from lodestone.operators.ranking import keep_top, with_rank
from lodestone.session import cut_lineage, stack

ATTRIBUTES = ["parent_chunk_id", "parent_doc_id", "source_type", "doc_semantic_type", "title", "section_heading"]


@dataclass(frozen=True)
class Corpus:
    """``children(item_id, text, attributes...)``, ``vectors(item_id, embedding)``, a graph and parent texts."""

    children: DataFrame
    vectors: DataFrame | None = None
    graph: graphs.Graph | None = None
    parents: DataFrame | None = None


@dataclass(frozen=True)
class Models:
    """``embed``: (query_id, query) → (query_id, embedding); ``score``: pairs → (query_id, item_id, score)."""

    embed: Callable[[DataFrame], DataFrame] | None = None
    score: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Retrieved:
    """``candidates``: chunks per question; ``documents``: first chunk per document, reranked where due;
    ``coverage``: the chunk list that evidence coverage reads, each chunk with the ids it stands for."""

    candidates: DataFrame
    documents: DataFrame
    coverage: DataFrame


def method_row(method: str) -> tuple:
    name = model.METHOD_ALIASES.get(method, method)
    for row in model.METHODS:
        if row[0] == name:
            return row
    raise ValueError(f"unknown retrieval method: {method}")


def retrieve(method: str, questions: DataFrame, corpus: Corpus, models: Models, search_k: int = 50, graph_k: int = 20,
             graph_depth: int = 1, rerank_k: int = 20, decisions: DataFrame | None = None) -> Retrieved:
    """Answer all ``questions(query_id, query, question_type, source_types, answer_facts)`` with one method.

    The method decides which channels enter the plan; a question's type decides, row by row, whether it is
    split into sub-queries and whether its documents are reranked.  Of several sub-queries that find a chunk,
    the one with the best score, then the first, gives its row.  A method with a graph needs one in the corpus.
    """
    _, use_vector, use_bm25, use_graph, use_boost, rerank_mode, decompose = method_row(method)
    if use_graph and corpus.graph is None:
        raise ValueError(f"method {method} needs a graph")
    asked = questions.select("query_id", "query", "question_type", "source_types", "answer_facts")
    if decompose:
        split = subqueries.expand_queries(asked, model.MAX_FACTS)
    else:
        split = asked.drop("answer_facts").withColumn("sub_query_id", F.lit("sq1"))
    # a sub-query searches under an id of its own and comes back to its question by the lookup
    probe_id = F.concat_ws("\u0001", "query_id", "sub_query_id")
    probes = split.select(probe_id.alias("query_id"), "query", F.col("source_types").alias("source_hints"))
    lookup = split.select(probe_id.alias("_probe"), F.col("query_id").alias("_question"),
                          F.substring("sub_query_id", 3, 10).cast("int").alias("_turn"))
    constraints = None
    if decisions is not None:
        constraints = lookup.drop("_turn").join(decisions.withColumnRenamed("query_id", "_question"), "_question").withColumnRenamed(
            "_probe", "query_id").drop("_question")
    attributes = corpus.children.select("item_id", *ATTRIBUTES)
    vector = bm25 = None
    if use_vector:
        vector = dense_channel(probes, corpus, models, search_k, constraints)
    if use_bm25:
        bm25 = lexical_channel(probes, corpus, search_k, constraints)
    if vector is not None and bm25 is not None:
        fused = fusion.rrf_fuse_children(vector, bm25).join(attributes, "item_id", "left")
        if use_graph:
            fused = _with_graph(fused, attributes, probes, corpus, graph_k, graph_depth, use_boost)
        scored = fused.withColumn("score", F.col("fused_score"))
    else:
        scored = (vector if vector is not None else bm25).drop("rank").join(attributes, "item_id", "left")
    found = F.coalesce("evidence_ids", F.array().cast("array<string>")) if "evidence_ids" in scored.columns else F.array().cast("array<string>")
    scored = scored.select("query_id", "item_id", "score", *ATTRIBUTES,
                           F.array_distinct(F.concat(F.array("item_id"), found)).alias("evidence_ids"))
    if use_boost:
        scored = filters.boost_sources(scored, probes)
    named = scored.join(lookup, F.col("query_id") == F.col("_probe"))
    row = F.struct("score", *ATTRIBUTES, "evidence_ids")
    best = named.groupBy(F.col("_question").alias("query_id"), "item_id").agg(
        F.max_by(row, F.struct("score", -F.col("_turn"))).alias("row")).select("query_id", "item_id", "row.*")
    candidates = with_rank(best, [F.col("score").desc(), F.col("item_id")])
    documents = fusion.dedup_docs(candidates)
    eligible = asked.select("query_id", "query", "question_type")
    if rerank_mode == "complex":
        eligible = eligible.filter(F.col("question_type").isin(model.RERANKED_TYPES))
    if rerank_mode == "none" or models.score is None:
        return Retrieved(candidates, documents, candidates.select("query_id", "item_id", "rank", "evidence_ids"))
    texts = _rerank_texts(corpus, use_graph)
    pairs = rerank.rerank_pairs(documents.join(eligible.select("query_id"), "query_id", "left_semi"), texts, eligible, rerank_k, model.RERANK_CHARS)
    reranked = rerank.rerank_window(documents, models.score(pairs), rerank_k)
    # questions that are not due have no scores: all of their window ties and keeps its order
    return Retrieved(candidates, reranked, rerank.coverage_order(candidates, reranked, eligible, ["evidence_ids"]))


def dense_channel(probes: DataFrame, corpus: Corpus, models: Models, k: int, decisions: DataFrame | None) -> DataFrame:
    queries = probes.select("query_id", "query").join(models.embed(probes.select("query_id", "query")), "query_id").select(
        "query_id", "embedding")
    vectors = corpus.vectors
    if decisions is not None:
        queries = filters.dense_filters(queries, decisions)
        vectors = filters.dense_attributes(vectors.join(corpus.children.select("item_id", *ATTRIBUTES), "item_id"))
    return knn_exact(queries, vectors, k)


def lexical_channel(probes: DataFrame, corpus: Corpus, k: int, decisions: DataFrame | None) -> DataFrame:
    if decisions is None:
        return lexical.bm25_search_children(probes, corpus.children, k)
    rows = filters.dense_attributes(corpus.children.select("item_id", "text", *ATTRIBUTES))
    index = lexical.bm25_index(rows, "child", carry=lexical.RULE_COLUMNS)
    found = lexical.bm25_search_admitted(probes, index, k, filters.dense_filters(probes.select("query_id"), decisions))
    if found is not None:
        return found
    scored = lexical.bm25_scores(lexical.query_terms(probes), index)
    attributed = scored.join(corpus.children.select("item_id", *ATTRIBUTES), "item_id")
    return keep_top(filters.hard_filter(attributed, decisions).select("query_id", "item_id", "score"), k)


def _with_graph(fused: DataFrame, attributes: DataFrame, probes: DataFrame, corpus: Corpus, k: int, depth: int, boost: bool) -> DataFrame:
    hinted = probes if boost else probes.withColumn("source_hints", F.array().cast("array<string>"))
    hits = graphs.graph_search(hinted, corpus.graph, k, depth)
    kinds = corpus.graph.parents.select(F.col("parent_chunk_id").alias("item_id"), *ATTRIBUTES)
    found = hits.join(kinds, "item_id").withColumn("evidence_ids", F.array("item_id"))
    merged = fusion.rrf_fuse_graph(fused, found)
    # a chunk that is child and parent under one id keeps the attributes of the child
    side = attributes.transform(stack, kinds.join(attributes.select("item_id"), "item_id", "left_anti"))
    rest = [c for c in ATTRIBUTES if c not in ("parent_chunk_id", "doc_semantic_type")]
    return merged.join(side.select("item_id", *rest), "item_id", "left")


def _rerank_texts(corpus: Corpus, use_graph: bool) -> DataFrame:
    """The parent text of a chunk, else its own; a parent that the graph alone found has its text there."""
    texts = corpus.children.select("item_id", "text")
    if corpus.parents is not None:
        parents = corpus.parents.select("parent_chunk_id", F.col("text").alias("_parent"))
        texts = corpus.children.select("item_id", "text", "parent_chunk_id").join(parents, "parent_chunk_id", "left").select(
            "item_id", F.coalesce("_parent", "text").alias("text"))
    if use_graph:
        found = corpus.graph.parents.select(F.col("parent_chunk_id").alias("item_id"), "text")
        texts = texts.transform(stack, found.join(corpus.children.select("item_id"), "item_id", "left_anti"))
    return texts


@dataclass(frozen=True)
class Evidence:
    """``selected``: the rows of each question's last pass; ``states``: how each question ended."""

    selected: DataFrame
    states: DataFrame


def evidence_passes(questions: DataFrame, decisions: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame],
                    max_retries: int = 1, sub_queries: DataFrame | None = None, acl: tuple[DataFrame, DataFrame] | None = None,
                    guarded: DataFrame | None = None) -> Evidence:
    """Search until each question has enough evidence or nothing is left to try.

    ``search(questions, decisions)`` returns the selected ``(query_id, item_id, rank, ...)``.  After a pass the
    evidence check and the next action route every question: hard filters are broadened once, then the query
    is rewritten up to ``max_retries`` times, always from the original text.  With ``sub_queries(query_id,
    sub_query_id)`` all of a question's must be among the ``matched_sub_query_ids`` of its rows.  ``acl``, a
    pair (queries with user_id, grants), removes rows a user may not see; a question that loses all of them, and
    one in ``guarded(query_id)``, stops as insufficient.  ``decisions`` may leave questions out: no filter.

    ``states(query_id, attempt, fallback_count, retry_count, n_documents, context_score, enough_evidence,
    next_action)``.  The last pass counts, whatever an earlier one found.  There are at most 2 + max_retries
    passes, each over the questions still open, and each is written once, so a later one never repeats it.
    """
    shown = ["query_id", "attempt", "fallback_count", "retry_count", "n_documents", "context_score", "enough_evidence", "next_action"]
    rule = decisions.select("query_id", "mode")
    begun = questions.join(rule, "query_id", "left").withColumn("mode", F.coalesce("mode", F.lit("none")))
    flag = F.lit(False) if guarded is None else F.coalesce("_guarded", F.lit(False))
    if guarded is not None:
        begun = begun.join(guarded.select("query_id", F.lit(True).alias("_guarded")).distinct(), "query_id", "left")
    zero = F.lit(0)
    asked = begun.select(*questions.columns, "mode", flag.alias("security_flag"), zero.alias("fallback_count"), zero.alias("retry_count"),
                         F.lit(max_retries).alias("max_retries"), F.col("query").alias("_original"))
    selected, states = [], []
    for attempt in range(1, max_retries + 3):
        current = asked.select("query_id", "mode", "fallback_count")
        given = decisions.join(current.filter("fallback_count = 0").select("query_id"), "query_id", "left_semi").transform(
            stack, broaden(decisions.join(current.filter("fallback_count > 0").select("query_id"), "query_id", "left_semi")))
        found, emptied = search(asked.select(*questions.columns), given), None
        if acl is not None:
            before = cut_lineage(found)
            found = filters.acl_filter(before, *acl)
            emptied = filters.acl_removed_all(before, found)
        found = cut_lineage(found.withColumn("attempt", F.lit(attempt)))
        mine = None if sub_queries is None else sub_queries.join(asked.select("query_id"), "query_id", "left_semi")
        # the action is chosen by what the user asked, not by the rewritten text
        checked = evidence_check(asked.withColumn("_asked", F.col("query")).withColumn("query", F.col("_original")), found, mine, emptied)
        judged = cut_lineage(next_action(checked).withColumn("query", F.col("_asked")).withColumn("attempt", F.lit(attempt)))
        again = F.col("next_action").isin("broaden_metadata_filter", "rewrite_query")
        ended = judged.filter(~again)
        selected.append(found.join(ended.select("query_id"), "query_id", "left_semi"))
        states.append(ended.select(*shown))
        broadened = judged.filter("next_action = 'broaden_metadata_filter'").withColumn("mode", F.lit("soft")).withColumn(
            "fallback_count", F.col("fallback_count") + 1)
        rewritten = subqueries.rewrite_queries(judged.filter("next_action = 'rewrite_query'").withColumn("query", F.col("_original"))).withColumn(
            "retry_count", F.col("retry_count") + 1)
        asked = broadened.transform(stack, rewritten).select(*asked.columns)
    return Evidence(reduce(stack, selected), reduce(stack, states))


def retrieve_with_fallback(questions: DataFrame, decisions: DataFrame,
                           search: Callable[[DataFrame, DataFrame], DataFrame], max_retries: int = 1, **evidence) -> DataFrame:
    """The selected rows of ``evidence_passes``: as decided, broadened, rewritten; the last pass of a question counts."""
    return evidence_passes(questions, decisions, search, max_retries, **evidence).selected

"""Planning rules as columns: filters, strategies, evidence, next steps, external search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import contains_any, mentions, strip

BROAD_REASON = "Broad intent may need cross-source evidence; use metadata as a boost instead of a hard filter."
HARD_REASON = "Query explicitly names both source and document type constraints."
SOFT_REASON = "Query suggests metadata constraints but does not require a narrow hard filter."
NO_REASON = "No whitelisted metadata constraint detected."


def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _first_match(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first case that holds; an unknown condition does not hold."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(default))


def _mentioned(text: Column, table: list[tuple]) -> Column:
    return F.array_compact(F.array(*[F.when(mentions(text, words, free), name) for name, words, free in table]))


def plan_metadata_filter(questions: DataFrame) -> DataFrame:
    """Add mode, source_types, doc_semantic_types, confidence and reason to ``questions(query, rag_intent,
    source_hints)``.

    Hints are normalised, limited to known sources and united with what the text names.  Broad intents only
    boost; a text that names both a source and a type filters; anything else boosts.
    """
    text = F.coalesce("query", F.lit(""))
    named = questions.withColumn("_sources", _mentioned(text, model.SOURCE_MENTIONS)).withColumn(
        "_types", _mentioned(text, model.TYPE_MENTIONS))
    hints = F.transform(_texts(F.col("source_hints")), lambda h: F.translate(F.lower(strip(h)), " -", "__"))
    known = F.array_distinct(F.filter(F.concat("_sources", hints), lambda s: s.isin(model.ALLOWED_SOURCES)))
    named = named.withColumn("source_types", known).withColumn("doc_semantic_types", F.col("_types"))
    nothing = (F.size("source_types") == 0) & (F.size("doc_semantic_types") == 0)
    broad = F.coalesce(F.col("rag_intent"), F.lit("")).isin(model.BROAD_INTENTS)
    explicit = (F.size("_sources") > 0) & (F.size("_types") > 0)
    return named.select(
        *questions.columns,
        _first_match([(nothing, "none"), (broad, "soft"), (explicit, "hard")], "soft").alias("mode"),
        "source_types", "doc_semantic_types", F.array().cast("array<string>").alias("title_keywords"),
        F.array().cast("array<string>").alias("section_keywords"),
        _first_match([(nothing, 0.0), (broad, 0.58), (explicit, 0.9)], 0.65).alias("confidence"),
        _first_match([(nothing, NO_REASON), (broad, BROAD_REASON), (explicit, HARD_REASON)], SOFT_REASON).alias("reason"))


def broaden(decisions: DataFrame) -> DataFrame:
    """Hard decisions become soft."""
    hard = F.col("mode") == "hard"
    return decisions.withColumn("reason", F.when(hard, F.concat(
        "reason", F.lit(" Broadened from hard filter after insufficient evidence."))).otherwise(F.col("reason"))).withColumn(
        "mode", F.when(hard, "soft").otherwise(F.col("mode")))


def select_strategy(questions: DataFrame) -> DataFrame:
    """Add the strategy of each question's intent; low confidence without a reranker switches one on and
    widens the search."""
    intent = F.coalesce("rag_intent", F.lit("unknown"))
    name, depth, final, rerank, rewrite, decompose = model.DEFAULT_STRATEGY

    def pick(position: int, default: object) -> Column:
        return _first_match([(intent == row[0], row[position]) for row in model.STRATEGIES], default)

    low = (F.col("router_confidence") < model.LOW_CONFIDENCE) & ~pick(4, rerank)
    low = F.coalesce(low, F.lit(False))
    final_k, search = pick(3, final), pick(2, depth)
    return questions.select(
        "*", F.when(low, model.LOW_CONFIDENCE_STRATEGY).otherwise(pick(1, name)).alias("strategy_name"),
        F.lit("hybrid").alias("retrieval_mode"), search.alias("top_k_dense"), search.alias("top_k_bm25"),
        F.when(low, F.greatest(search, F.lit(60))).otherwise(search).alias("fusion_top_k"),
        F.when(low, F.greatest(final_k, F.lit(8))).otherwise(final_k).alias("final_top_k"),
        (pick(4, rerank) | low).alias("use_reranker"), pick(5, rewrite).alias("use_query_rewrite"),
        pick(6, decompose).alias("use_decompose"), F.lit("insufficient_evidence").alias("fallback_policy"))


def k_for_intent(intent: Column) -> Column:
    return F.when(intent.isin(model.BROAD_INTENTS), 10).when(intent.isin(model.NARROW_INTENTS), 8).otherwise(5)


def search_k_for_intent(intent: Column) -> Column:
    return F.when(intent.isin(model.BROAD_INTENTS), 80).when(intent.isin(model.NARROW_INTENTS), 60).otherwise(40)


def needs_rerank(intent: Column, confidence: Column, flag: Column) -> Column:
    """An explicit flag decides, else the intent, else low confidence."""
    by_rule = F.coalesce(intent.isin(model.RERANKED_TYPES), F.lit(False)) | F.coalesce(
        confidence < model.LOW_CONFIDENCE, F.lit(False))
    return F.coalesce(flag, by_rule)


def task_type(intent: Column, query: Column) -> Column:
    return _first_match([
        (intent.isin(model.PASS_THROUGH_TASKS), intent),
        (intent.isin("semantic", "high_level"), "semantic_query"),
        (intent.isin("intra_document_reasoning", "project_related", "completeness"), "multi_hop"),
        ((intent == "conflicting_info") | F.lower(query).contains("compare"), "comparison"),
    ], "fact_lookup")


def generation_intent(question_type: Column) -> Column:
    """The intent an answer is generated with."""
    kind = strip(F.coalesce(question_type, F.lit("")))
    return _first_match([
        (kind.isin("semantic", "semantic_query", "high_level"), "semantic_query"),
        (kind.isin("multi_hop", "project_related"), "multi_hop"),
        (kind.isin("comparison", "conflicting_info"), "comparison"),
        (kind == "procedure", "procedure"),
        (kind.isin("constrained", "completeness"), "constrained"),
        (kind.isin("fact_lookup", "lookup"), "fact_lookup"),
        (F.coalesce(question_type, F.lit("")) == "", "unknown"),
    ], question_type)


def evidence_check(questions: DataFrame, selected: DataFrame, sub_queries: DataFrame | None = None,
                   acl_emptied: DataFrame | None = None) -> DataFrame:
    """Add n_documents, n_covered, n_aspects, context_score and enough_evidence to each question.

    With sub-queries every one must have a selected document; ``selected`` then carries the array
    ``matched_sub_query_ids``.  Without, any document is enough.
    """
    documents = selected.groupBy("query_id").agg(F.count("*").alias("n_documents"))
    table = questions.join(documents, "query_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    if acl_emptied is not None:
        table = table.join(acl_emptied.select("query_id", F.lit(True).alias("acl_emptied")), "query_id", "left")
    else:
        table = table.withColumn("acl_emptied", F.lit(False))
    table = table.withColumn("acl_emptied", F.coalesce("acl_emptied", F.lit(False)))
    if sub_queries is not None:
        matched = selected.select("query_id", F.explode("matched_sub_query_ids").alias("sub_query_id")).distinct()
        wanted = sub_queries.select("query_id", "sub_query_id").distinct()
        covered = wanted.join(matched.withColumn("_hit", F.lit(1)), ["query_id", "sub_query_id"], "left").groupBy(
            "query_id").agg(F.count("*").alias("n_sub_queries"), F.count("_hit").alias("n_matched"))
        table = table.join(covered, "query_id", "left")
    else:
        table = table.withColumn("n_sub_queries", F.lit(None).cast("bigint")).withColumn("n_matched", F.lit(None).cast("bigint"))
    split = F.coalesce("n_sub_queries", F.lit(0)) > 0
    any_document = (F.col("n_documents") > 0) & ~F.col("acl_emptied")
    enough = any_document & (~split | (F.col("n_matched") == F.col("n_sub_queries")))
    one_aspect = F.when(any_document, F.least(F.lit(1.0), F.col("n_documents").cast("double"))).otherwise(0.0)
    return table.select(
        *questions.columns, "n_documents", "acl_emptied", F.when(split, F.col("n_sub_queries")).otherwise(1).alias("n_aspects"),
        F.when(split, F.col("n_matched")).otherwise(enough.cast("bigint")).alias("n_covered"),
        F.when(split, F.col("n_matched") / F.col("n_sub_queries")).otherwise(one_aspect).alias("context_score"),
        enough.alias("enough_evidence"))


def needs_public_context(query: Column) -> Column:
    return contains_any(query, model.PUBLIC_MARKERS)


def next_action(checked: DataFrame) -> DataFrame:
    """Add next_action to ``checked(query, enough_evidence, acl_emptied, security_flag, mode, fallback_count,
    retry_count, max_retries)``."""
    enough = F.col("enough_evidence")
    return checked.withColumn("next_action", _first_match([
        (F.col("security_flag") | F.col("acl_emptied"), "insufficient_evidence"),
        (enough & needs_public_context(F.col("query")), "external_search"),
        (enough, "generate"),
        ((F.col("mode") == "hard") & (F.col("fallback_count") < 1), "broaden_metadata_filter"),
        (F.col("retry_count") >= F.col("max_retries"), "external_search"),
    ], "rewrite_query"))


def expand_top_k(strategies: DataFrame) -> DataFrame:
    """Double both cuts, up to 20 and 120."""
    return strategies.withColumn("final_top_k", F.least(F.col("final_top_k") * 2, F.lit(20))).withColumn(
        "fusion_top_k", F.least(F.col("fusion_top_k") * 2, F.lit(120)))


def external_search_decision(questions: DataFrame, company_names: list[str] | None = None) -> DataFrame:
    """Add external_mode, external_allowed and evidence_mode to ``questions(query, rag_intent, blocked,
    enough_evidence)``.  ``company_names`` are further words that mark a question as internal."""
    text = F.coalesce("query", F.lit(""))
    internal = contains_any(text, model.COMPANY_MARKERS + [n.lower() for n in company_names or []])
    generic = contains_any(text, model.MISSING_MARKERS) & (
        contains_any(text, model.GENERIC_REFERENCE_MARKERS) | contains_any(text, model.GENERIC_MARKERS))
    public = needs_public_context(text)
    private_fact = internal & contains_any(text, model.PRIVATE_FACT_MARKERS) & (
        contains_any(text, model.SPECIFIC_MARKERS) | generic)
    own_procedure = internal & contains_any(text, model.PROCEDURE_MARKERS) & ~generic
    enough = F.col("enough_evidence")
    mode = _first_match([
        (F.col("blocked"), "none"), (enough & public, "hybrid"), (enough, "none"), (private_fact | own_procedure, "none"),
        (generic | public | (F.col("rag_intent") == "procedure"), "fallback"),
    ], "none")
    return questions.withColumn("external_mode", mode).withColumn(
        "external_allowed", F.col("external_mode") != "none").withColumn("evidence_mode", F.when(
            F.col("external_mode") == "hybrid", "hybrid").when(F.col("external_mode") == "fallback", "web_fallback").otherwise("internal_only"))


def route_action(decisions: DataFrame) -> DataFrame:
    """Safety first, then clarification, then retrieval, then the action that was chosen if it is known."""
    return decisions.withColumn("action", _first_match([
        (F.col("safety_risk"), "refuse"), (F.col("needs_clarification"), "clarify"), (F.col("needs_retrieval"), "retrieve"),
        (F.col("action").isin("direct_answer", "tool_call", "refuse", "clarify", "retrieve"), F.col("action")),
    ], "retrieve"))

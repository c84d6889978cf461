"""Planning rules over generated questions: one per part or order, phrases chosen by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import text as T
from catalog import views as V
from lodestone import model
from lodestone.functions import rules

TOPICS = ["Slack thread policy", "gmail", "open jira tickets", "the GitHub commit and design doc", "会议记录 in fireflies", "nothing special",
          "wiki architecture", "hubspot account notes", "RFC or ADR", "constant rulers"]
INTENTS = ["fact_lookup", "semantic_query", "multi_hop", "comparison", "procedure", "constrained", "follow_up", "completeness", "other"]
HINTS = ["Google Drive", "slack", "no such source", " Jira ", "google-drive"]


def listed(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def listed_sql(values, key):
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({key} % {len(values)} + 1)::INTEGER)"


def asked(spark, sf):
    p = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        p.cast("string").alias("query_id"), F.concat(F.lit("What about "), listed(TOPICS, p), F.lit(" for "), "p_name", F.lit("?")).alias("query"),
        listed(INTENTS, F.floor(p / 10)).alias("rag_intent"),
        F.when(p % 3 == 0, F.array(listed(HINTS, F.floor(p / 3)), F.lit("slack"))).alias("source_hints"),
        (F.col("p_size") / 50).alias("router_confidence"), F.when(p % 7 == 0, p % 2 == 0).alias("use_reranker_flag"))


V.SQL["rule_asked"] = f"""
SELECT p_partkey::VARCHAR AS query_id, 'What about ' || {listed_sql(TOPICS, 'p_partkey')} || ' for ' || p_name || '?' AS query,
  {listed_sql(INTENTS, '(p_partkey // 10)')} AS rag_intent, CASE WHEN p_partkey % 3 = 0 THEN [{listed_sql(HINTS, '(p_partkey // 3)')}, 'slack'] ELSE [] END AS source_hints,
  p_size / 50 AS router_confidence, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 2 = 0 END AS use_reranker_flag FROM part"""


def mention_sql(table):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(query, '{T.sql_words(w, f)}') THEN '{n}' END" for n, w, f in table) + "], lambda x: x IS NOT NULL)"


def in_list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


V.SQL["planned"] = f"""
SELECT *, len(s) = 0 AND len(t) = 0 AS nothing FROM (SELECT *, list_distinct(list_filter(list_concat(named, list_transform(source_hints, lambda h: replace(replace(lower(trim(h)), ' ', '_'), '-', '_'))),
  lambda x: x IN {in_list(model.ALLOWED_SOURCES)})) AS s FROM (SELECT *, {mention_sql(model.SOURCE_MENTIONS)} AS named, {mention_sql(model.TYPE_MENTIONS)} AS t FROM rule_asked))"""


@query("e01_plan_metadata_filter", V.ctes("rule_asked", "planned") + f"""
SELECT query_id, CASE WHEN nothing THEN 'none' WHEN rag_intent IN {in_list(model.BROAD_INTENTS)} THEN 'soft' WHEN len(named) > 0 AND len(t) > 0 THEN 'hard' ELSE 'soft' END AS mode,
  array_to_string(list_sort(s), '|') AS source_types, array_to_string(t, '|') AS doc_semantic_types,
  CASE WHEN nothing THEN 0.0 WHEN rag_intent IN {in_list(model.BROAD_INTENTS)} THEN 0.58 WHEN len(named) > 0 AND len(t) > 0 THEN 0.9 ELSE 0.65 END::DOUBLE AS confidence FROM planned""")
def e01(spark, sf):
    return rules.plan_metadata_filter(asked(spark, sf)).select(
        "query_id", "mode", F.array_join(F.array_sort("source_types"), "|").alias("source_types"), F.array_join("doc_semantic_types", "|").alias("doc_semantic_types"), "confidence")


STRATEGY_ROWS = ", ".join(f"('{i}', '{n}', {d}, {k}, {str(r).lower()}, {str(w).lower()}, {str(x).lower()})" for i, n, d, k, r, w, x in model.STRATEGIES)
V.SQL["strategies"] = f"""
SELECT query_id, low, CASE WHEN low THEN 'low_confidence_hybrid_reranker' ELSE name END AS strategy_name, depth AS top_k_dense,
  CASE WHEN low THEN greatest(depth, 60) ELSE depth END AS fusion_top_k, CASE WHEN low THEN greatest(k, 8) ELSE k END AS final_top_k, rr OR low AS use_reranker, rw AS use_query_rewrite, dec AS use_decompose
FROM (SELECT query_id, router_confidence, coalesce(name, 'conservative_hybrid') AS name, coalesce(depth, 40) AS depth, coalesce(k, 5) AS k, coalesce(rr, false) AS rr, coalesce(rw, false) AS rw,
  coalesce(dec, false) AS dec, router_confidence < 0.65 AND NOT coalesce(rr, false) AS low FROM rule_asked LEFT JOIN (VALUES {STRATEGY_ROWS}) s(rag_intent, name, depth, k, rr, rw, dec) USING (rag_intent))"""


@query("e02_select_strategy", V.ctes("rule_asked", "strategies") + " SELECT * EXCLUDE (low) FROM strategies")
def e02(spark, sf):
    return rules.select_strategy(asked(spark, sf)).select(
        "query_id", "strategy_name", "top_k_dense", "fusion_top_k", "final_top_k", "use_reranker", "use_query_rewrite", "use_decompose")


@query("e03_k_for_intent", V.ctes("rule_asked") + f"""
SELECT query_id, CASE WHEN rag_intent IN {in_list(model.BROAD_INTENTS)} THEN 10 WHEN rag_intent IN {in_list(model.NARROW_INTENTS)} THEN 8 ELSE 5 END AS k,
  CASE WHEN rag_intent IN {in_list(model.BROAD_INTENTS)} THEN 80 WHEN rag_intent IN {in_list(model.NARROW_INTENTS)} THEN 60 ELSE 40 END AS search_k FROM rule_asked""")
def e03(spark, sf):
    return asked(spark, sf).select("query_id", rules.k_for_intent(F.col("rag_intent")).alias("k"), rules.search_k_for_intent(F.col("rag_intent")).alias("search_k"))


@query("e04_needs_rerank", V.ctes("rule_asked") + f"""
SELECT query_id, coalesce(use_reranker_flag, rag_intent IN {in_list(model.RERANKED_TYPES)} OR router_confidence < 0.65) AS needs FROM rule_asked""")
def e04(spark, sf):
    return asked(spark, sf).select("query_id", rules.needs_rerank(F.col("rag_intent"), F.col("router_confidence"), F.col("use_reranker_flag")).alias("needs"))


MORE = ["fact_lookup", "semantic", "high_level", "project_related", "conflicting_info", "compared", "", "lookup", "procedure"]


@query("e05_task_type", f"""
SELECT p_partkey, CASE WHEN i IN {in_list(model.PASS_THROUGH_TASKS)} THEN i WHEN i IN ('semantic', 'high_level') THEN 'semantic_query'
  WHEN i IN ('intra_document_reasoning', 'project_related', 'completeness') THEN 'multi_hop' WHEN i = 'conflicting_info' OR contains(lower(q), 'compare') THEN 'comparison' ELSE 'fact_lookup' END AS task_type,
  CASE WHEN i IN ('semantic', 'high_level') THEN 'semantic_query' WHEN i = 'project_related' THEN 'multi_hop' WHEN i = 'conflicting_info' THEN 'comparison' WHEN i = 'lookup' THEN 'fact_lookup' WHEN i = '' THEN 'unknown' ELSE i END AS generation_intent
FROM (SELECT p_partkey, {listed_sql(MORE, 'p_partkey')} AS i, CASE WHEN p_partkey % 4 = 1 THEN 'COMPARE ' ELSE '' END || p_name AS q FROM part)""")
def e05(spark, sf):
    p = F.col("p_partkey")
    rows = V.table(spark, sf, "part").select(p, listed(MORE, p).alias("i"), F.concat(F.when(p % 4 == 1, "COMPARE ").otherwise(""), "p_name").alias("q"))
    return rows.select("p_partkey", rules.task_type(F.col("i"), F.col("q")).alias("task_type"), rules.generation_intent(F.col("i")).alias("generation_intent"))


# a question per order; its lines select documents and say which sub-queries they match
def orders_checked(spark, sf):
    orders = V.table(spark, sf, "orders")
    questions = orders.select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "industry trends of ").otherwise("state of "), F.col("o_custkey").cast("string")).alias("query"),
        (F.col("o_orderkey") % 41 == 0).alias("security_flag"), F.when(F.col("o_orderstatus") == "F", "hard").otherwise("soft").alias("mode"),
        (F.col("o_orderkey") % 2).cast("int").alias("fallback_count"), (F.col("o_orderkey") % 3).cast("int").alias("retry_count"), F.lit(1).alias("max_retries"))
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("query_id"), "l_returnflag", F.concat(F.lit("sq"), F.col("l_linenumber") % 3).alias("s"))
    matched = F.when(F.col("l_returnflag") != "R", F.array("s")).otherwise(F.array().cast("array<string>"))
    selected = lines.select("query_id", matched.alias("matched_sub_query_ids"))
    subs = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").cast("string").alias("query_id"), F.explode(F.array(F.lit("sq0"), F.lit("sq1"), F.lit("sq2"))).alias("sub_query_id"))
    emptied = orders.filter("o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("query_id"))
    return rules.evidence_check(questions, selected, subs, emptied)


V.SQL["checked"] = """
SELECT *, CASE WHEN split THEN n_matched ELSE any_document::BIGINT END AS n_covered, CASE WHEN split THEN n_matched / 3 WHEN any_document THEN 1.0 ELSE 0.0 END AS context_score,
  any_document AND (NOT split OR n_matched = 3) AS enough_evidence FROM (
  SELECT o_orderkey::VARCHAR AS query_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority = '1-URGENT' AS split, o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 AS acl_emptied,
    coalesce(n, 0) AS n_documents, coalesce(m, 0) AS n_matched, coalesce(n, 0) > 0 AND NOT (o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0) AS any_document
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_linenumber % 3 END) AS m FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey)"""


@query("e06_evidence_check", V.ctes("checked") + """
SELECT query_id, n_documents, acl_emptied, CASE WHEN split THEN 3 ELSE 1 END::BIGINT AS n_aspects, n_covered, round(context_score, 6) AS context_score, enough_evidence FROM checked""")
def e06(spark, sf):
    return orders_checked(spark, sf).select("query_id", "n_documents", "acl_emptied", "n_aspects", "n_covered", F.round("context_score", 6).alias("context_score"), "enough_evidence")


@query("e07_next_action", V.ctes("checked") + """
SELECT query_id, CASE WHEN o_orderkey % 41 = 0 OR acl_emptied THEN 'insufficient_evidence' WHEN enough_evidence AND o_orderkey % 5 = 0 THEN 'external_search' WHEN enough_evidence THEN 'generate'
  WHEN o_orderstatus = 'F' AND o_orderkey % 2 < 1 THEN 'broaden_metadata_filter' WHEN o_orderkey % 3 >= 1 THEN 'external_search' ELSE 'rewrite_query' END AS next_action FROM checked""")
def e07(spark, sf):
    return rules.next_action(orders_checked(spark, sf)).select("query_id", "next_action")


@query("e09_expand_top_k", V.ctes("rule_asked", "strategies") + " SELECT query_id, least(final_top_k * 2, 20) AS final_top_k, least(fusion_top_k * 2, 120) AS fusion_top_k FROM strategies")
def e09(spark, sf):
    return rules.expand_top_k(rules.select_strategy(asked(spark, sf))).select("query_id", "final_top_k", "fusion_top_k")


SUBJECTS = ["our company salary band", "internal docs deployment endpoint: what is it", "my company PTO procedure", "how to request leave", "我们公司 报销上限 是多少",
            "industry best practices", "if the knowledge base does not have it, give a generic reference", "our internal process, not found: common reference", "weather", "本公司 绩效"]


@query("e10_external_search_decision", f"""
SELECT o_orderkey, mode AS external_mode, mode <> 'none' AS external_allowed, CASE mode WHEN 'hybrid' THEN 'hybrid' WHEN 'fallback' THEN 'web_fallback' ELSE 'internal_only' END AS evidence_mode FROM (
  SELECT *, CASE WHEN blocked THEN 'none' WHEN enough AND pub THEN 'hybrid' WHEN enough THEN 'none' WHEN internal AND priv AND (spec OR generic) THEN 'none' WHEN internal AND proc AND NOT generic THEN 'none'
    WHEN generic OR pub OR intent = 'procedure' THEN 'fallback' ELSE 'none' END AS mode FROM (
  SELECT o_orderkey, o_orderkey % 31 = 0 AS blocked, o_orderstatus = 'F' AS enough, CASE WHEN o_orderkey % 4 = 0 THEN 'procedure' ELSE 'fact_lookup' END AS intent,
    {' OR '.join(f"contains(q, '{m}')" for m in model.COMPANY_MARKERS)} AS internal, {' OR '.join(f"contains(q, '{m}')" for m in model.PRIVATE_FACT_MARKERS)} AS priv,
    {' OR '.join(f"contains(q, '{m}')" for m in model.SPECIFIC_MARKERS)} AS spec, {' OR '.join(f"contains(q, '{m}')" for m in model.PROCEDURE_MARKERS)} AS proc,
    ({' OR '.join(f"contains(q, '{m}')" for m in model.MISSING_MARKERS)}) AND ({' OR '.join(f"contains(q, '{m}')" for m in model.GENERIC_MARKERS + model.GENERIC_REFERENCE_MARKERS)}) AS generic,
    {' OR '.join(f"contains(q, '{m}')" for m in model.PUBLIC_MARKERS)} AS pub
  FROM (SELECT *, lower({listed_sql(SUBJECTS, 'o_orderkey')} || ' ' || {listed_sql(SUBJECTS, '(o_orderkey // 10)')}) AS q FROM orders)))""")
def e10(spark, sf):
    o = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(
        o, F.concat_ws(" ", listed(SUBJECTS, o), listed(SUBJECTS, F.floor(o / 10))).alias("query"), (o % 31 == 0).alias("blocked"),
        (F.col("o_orderstatus") == "F").alias("enough_evidence"), F.when(o % 4 == 0, "procedure").otherwise("fact_lookup").alias("rag_intent"))
    return rules.external_search_decision(rows).select("o_orderkey", "external_mode", "external_allowed", "evidence_mode")


ACTIONS = ["direct_answer", "tool_call", "dance", "clarify"]


@query("e11_route_action", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'refuse' WHEN o_orderkey % 7 = 0 THEN 'clarify' WHEN o_orderstatus = 'F' THEN 'retrieve'
  WHEN a IN ('direct_answer', 'tool_call', 'refuse', 'clarify', 'retrieve') THEN a ELSE 'retrieve' END AS action FROM (SELECT *, {listed_sql(ACTIONS, 'o_orderkey')} AS a FROM orders)""")
def e11(spark, sf):
    o = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(
        o, (o % 11 == 0).alias("safety_risk"), (o % 7 == 0).alias("needs_clarification"), (F.col("o_orderstatus") == "F").alias("needs_retrieval"), listed(ACTIONS, o).alias("action"))
    return rules.route_action(rows).select("o_orderkey", "action")

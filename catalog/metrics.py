"""Evaluation queries.  Questions are customers, rankings their purchases, gold their discounted returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import views as V
from lodestone.operators import diagnostics, judging, metrics, summaries

KS = V.KS
M = V.ctes(*V.METRICS)


def per_question(spark, sf):
    return metrics.question_metrics(V.asked(spark, sf), V.ranking(spark, sf), V.returned(spark, sf), KS)


def inputs(spark, sf):
    return V.asked(spark, sf), V.ranking(spark, sf), V.returned(spark, sf)


def single(key: str, name: str, operator):
    kind = "" if name == "hit" else "round({0}, 6) AS ".format(name)

    @query(key, M + f" SELECT question_id, k, {kind}{name} FROM metrics")
    def run(spark, sf):
        found = operator(*inputs(spark, sf), KS)
        return found if name == "hit" else found.withColumn(name, F.round(name, 6))


single("g01_hit_at_k", "hit", metrics.hit_at_k)
single("g02_precision_at_k", "precision", metrics.precision_at_k)
single("g03_recall_at_k", "recall", metrics.recall_at_k)
single("g04_f1_at_k", "f1", metrics.f1_at_k)
single("g05_rr_at_k", "rr", metrics.rr_at_k)
single("g06_ap_at_k", "ap", metrics.ap_at_k)
single("g07_ndcg_at_k", "ndcg", metrics.ndcg_at_k)

V.SQL["coverage"] = f"""
SELECT q.question_id, k, coalesce(any_value(n_groups), 0) AS n_groups,
  CASE WHEN any_value(n_groups) > 0 THEN count(first_rank) FILTER (first_rank <= k) / any_value(n_groups) ELSE 0 END
    AS evidence_coverage
FROM asked q CROSS JOIN (SELECT unnest({KS}) AS k)
LEFT JOIN (SELECT question_id, count(DISTINCT group_id) AS n_groups FROM evidence_groups GROUP BY ALL) USING (question_id)
LEFT JOIN (SELECT question_id, group_id, min(rank) AS first_rank FROM ranking
  JOIN evidence_groups g USING (question_id) WHERE ranking.item_id = g.evidence_id GROUP BY ALL) USING (question_id)
GROUP BY q.question_id, k"""
COVERED = V.ctes(*V.METRICS, "evidence_groups", "coverage")


def coverage(spark, sf):
    ranked = V.ranking(spark, sf)
    evidence = ranked.select("question_id", "rank", F.array("item_id").alias("evidence_ids"))
    return metrics.evidence_coverage_at_k(V.asked(spark, sf), evidence, V.evidence_groups(spark, sf), KS)


@query("g08_evidence_coverage_at_k", COVERED + """
SELECT question_id, k, n_groups, round(evidence_coverage, 6) AS evidence_coverage FROM coverage""")
def g08(spark, sf):
    return coverage(spark, sf).withColumn("evidence_coverage", F.round("evidence_coverage", 6))


V.SQL["tall"] = """
SELECT question_id, k, n_expected, unnest(['hit', 'precision', 'recall', 'f1', 'ndcg', 'ap', 'map', 'mrr']) AS metric,
  unnest([hit, precision, recall, f1, ndcg, ap, ap, rr]::DOUBLE[]) AS value FROM metrics"""
V.SQL["kept"] = "SELECT * FROM tall WHERE metric <> 'mrr' OR k = 20"


def run_summary_sql(where: str) -> str:
    return f"""
SELECT metric, k, round(avg(value), 4) AS value FROM kept WHERE metric <> 'ap' AND {where} GROUP BY ALL
UNION ALL SELECT 'questions', 0, count(*)::DOUBLE FROM metrics WHERE k = 20 AND {where}
UNION ALL SELECT 'average_latency_ms', 0, round(avg(latency_ms), 2) FROM asked JOIN metrics USING (question_id)
  WHERE k = 20 AND {where}
UNION ALL SELECT 'evidence_coverage', c.k, round(avg(evidence_coverage), 4) FROM coverage c
  JOIN metrics m ON m.question_id = c.question_id AND m.k = c.k WHERE n_groups > 0 AND {where} GROUP BY c.k
UNION ALL SELECT 'evidence_coverage_questions', 0, count(*)::DOUBLE FROM coverage WHERE n_groups > 0 AND k = 20"""


SUMMED = V.ctes(*V.METRICS, "evidence_groups", "coverage", "tall", "kept")


@query("g09_summarize_run", SUMMED + run_summary_sql("true"))
def g09(spark, sf):
    return summaries.summarize_run(V.asked(spark, sf), per_question(spark, sf), KS, coverage(spark, sf))


def group_sql(groups: str, covered: bool = True) -> str:
    extra = """
UNION ALL SELECT grp, 'evidence_coverage', k, round(avg(evidence_coverage), 9) FROM groups
  JOIN coverage USING (question_id) WHERE n_groups > 0 GROUP BY ALL""" if covered else ""
    return f""", groups AS ({groups}), g AS (
SELECT grp, metric, k, round(avg(value), 9) AS value FROM groups JOIN kept USING (question_id) GROUP BY ALL
UNION ALL SELECT grp, 'questions', 0, count(*)::DOUBLE FROM groups GROUP BY ALL
UNION ALL SELECT grp, 'average_latency_ms', 0, round(avg(latency_ms), 9) FROM groups JOIN asked USING (question_id)
  GROUP BY ALL {extra})
SELECT grp AS "group", metric, k, value FROM g"""


@query("g10_group_summary", SUMMED + group_sql("SELECT DISTINCT question_id, unnest(source_types) AS grp FROM asked"))
def g10(spark, sf):
    return summaries.group_summary(V.asked(spark, sf), per_question(spark, sf), "source_types", KS, True,
                                   coverage(spark, sf)).withColumn("value", F.round("value", 9))


@query("g10_question_type_summary", SUMMED + group_sql("SELECT question_id, question_type AS grp FROM asked"))
def g10_types(spark, sf):
    return summaries.group_summary(V.asked(spark, sf), per_question(spark, sf), "question_type", KS, False,
                                   coverage(spark, sf)).withColumn("value", F.round("value", 9))


# the type of a part stands for the semantic type of a document; ECONOMY parts have none
TYPED = """
typed AS (SELECT question_id, item_id, coalesce(nullif(kind, ''), 'generic_doc') AS grp FROM returned LEFT JOIN (
  SELECT p_partkey::VARCHAR AS item_id, CASE WHEN p_type = 'ECONOMY' THEN '' ELSE lower(p_type) END AS kind FROM part)
  USING (item_id)),
thits AS (SELECT question_id, grp, item_id, min(rank) AS rank FROM ranking JOIN typed USING (question_id, item_id)
  WHERE rank <= 20 GROUP BY ALL),
tnum AS (SELECT *, row_number() OVER (PARTITION BY question_id, grp ORDER BY rank) AS hit_no FROM thits),
texp AS (SELECT question_id, grp, count(*) AS n_expected FROM typed GROUP BY ALL),
tcount AS (SELECT question_id, grp, k, any_value(n_expected) AS n_expected,
  count(rank) FILTER (rank <= k) AS n_hits, min(rank) AS first_rank,
  coalesce(sum(hit_no / rank) FILTER (rank <= k), 0) AS ap_sum,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg
  FROM texp CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS k) LEFT JOIN tnum USING (question_id, grp) GROUP BY ALL),
tmetrics AS (""" + V.SQL["metrics"].replace("SELECT question_id,", "SELECT question_id, grp,").replace("FROM counted", "FROM tcount") + """),
ttall AS (SELECT grp, k, unnest(['hit', 'precision', 'recall', 'f1', 'ndcg', 'ap', 'map', 'mrr']) AS metric,
  unnest([hit, precision, recall, f1, ndcg, ap, ap, rr]::DOUBLE[]) AS value FROM tmetrics),
tsum AS (SELECT grp, metric, k, round(avg(value), 9) AS value FROM ttall WHERE metric <> 'mrr' OR k = 20 GROUP BY ALL
UNION ALL SELECT grp, 'questions', 0, count(*)::DOUBLE FROM texp GROUP BY ALL
UNION ALL SELECT grp, 'average_latency_ms', 0, round(avg(latency_ms), 9) FROM texp JOIN asked USING (question_id) GROUP BY ALL)
SELECT grp AS "group", metric, k, value FROM tsum"""


def part_types(spark, sf):
    kind = F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.lower("p_type"))
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), kind.alias("doc_semantic_type"))


@query("g11_doc_type_summary", V.ctes("purchases", "asked", "ranking", "returned") + "," + TYPED)
def g11(spark, sf):
    return summaries.doc_type_summary(*inputs(spark, sf), part_types(spark, sf), KS).withColumn(
        "value", F.round("value", 9))


@query("g12_evidence_only_summary", SUMMED + run_summary_sql("n_expected > 0") + """
UNION ALL SELECT 'excluded_questions_without_expected_docs', 0, count(*)::DOUBLE FROM metrics
  WHERE k = 20 AND n_expected = 0""")
def g12(spark, sf):
    return summaries.evidence_only_summary(V.asked(spark, sf), per_question(spark, sf), KS, coverage(spark, sf))


@query("g13_non_retrieval_summary", V.ctes("purchases", "asked", "returned") + """
SELECT question_type, count(*) AS questions FROM asked ANTI JOIN returned USING (question_id) GROUP BY ALL""")
def g13(spark, sf):
    return summaries.non_retrieval_summary(V.asked(spark, sf), V.returned(spark, sf))


@query("g14_failure_reasons", COVERED + """,
sized AS (SELECT question_id, count(*) AS n_candidates FROM ranking GROUP BY ALL),
reasons AS (SELECT m.question_id, CASE WHEN coalesce(n_candidates, 0) = 0 THEN ['no_candidates'] ELSE list_filter([
  CASE WHEN m.hit = 0 THEN 'no_gold_hit' END, CASE WHEN m.recall < 0.5 THEN 'low_recall' END,
  CASE WHEN CASE WHEN m.n_expected > 0 THEN m.precision / (least(m.n_expected, 20) / 20) < 0.5
    ELSE m.precision < 0.2 END THEN 'low_precision' END,
  CASE WHEN m.ndcg < 0.5 THEN 'low_ndcg' END, CASE WHEN m.ap < 0.5 THEN 'low_map' END,
  CASE WHEN n_groups > 0 AND evidence_coverage < 1 THEN 'evidence_group_missing' END,
  CASE WHEN question_type = 'building' AND one.hit = 0 THEN 'reranker_top1_miss' END], lambda r: r IS NOT NULL) END AS r
FROM metrics m JOIN metrics one ON one.question_id = m.question_id AND one.k = 1 AND m.k = 20
JOIN coverage c ON c.question_id = m.question_id AND c.k = 20 JOIN asked a ON a.question_id = m.question_id
LEFT JOIN sized s ON s.question_id = m.question_id)
SELECT question_id, array_to_string(r, '|') AS failure_reasons FROM reasons WHERE len(r) > 0""")
def g14(spark, sf):
    asked, ranked, _ = inputs(spark, sf)
    found = per_question(spark, sf)
    details = (found.filter("k = 20")
               .join(found.filter("k = 1").select("question_id", F.col("hit").alias("hit_at_1")), "question_id")
               .join(coverage(spark, sf).filter("k = 20").drop("k"), "question_id")
               .join(asked.select("question_id", (F.col("question_type") == "building").alias("reranker_used")), "question_id")
               .join(ranked.groupBy("question_id").agg(F.count("*").alias("n_candidates")), "question_id", "left")
               .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0))))
    return summaries.failure_reasons(details, 20).select(
        "question_id", F.array_join("failure_reasons", "|").alias("failure_reasons"))


def other_ranking(spark, sf):
    """The baseline run: the same purchases, cheapest first."""
    order = V.Window.partitionBy("question_id").orderBy("l_extendedprice", "l_orderkey", "item_id")
    return V.purchases(spark, sf).withColumn("rank", F.row_number().over(order)).select("question_id", "item_id", "rank")


V.SQL["base_ranking"] = V.SQL["ranking"].replace("l_extendedprice DESC", "l_extendedprice")
BASE = []
for name in ("hits", "numbered", "counted", "metrics"):
    body = V.SQL[name]
    for old in ("ranking", "hits", "numbered", "counted"):
        body = body.replace(f"FROM {old}", f"FROM base_{old}").replace(f"JOIN {old}", f"JOIN base_{old}")
    V.SQL[f"base_{name}"] = body
    BASE.append(f"base_{name}")
TWO_RUNS = V.ctes(*V.METRICS, "base_ranking", *BASE)


def type_metrics(spark, sf, ranked):
    asked, _, gold = inputs(spark, sf)
    found = metrics.question_metrics(asked, ranked, gold, KS)
    return summaries.group_summary(asked, found, "question_type", KS)


@query("g15_metric_delta", TWO_RUNS + """,
flat AS (SELECT question_id, m.k, unnest(['hit', 'precision', 'recall', 'f1', 'ndcg', 'ap', 'map', 'mrr']) AS metric,
    unnest([m.hit, m.precision, m.recall, m.f1, m.ndcg, m.ap, m.ap, m.rr]::DOUBLE[]) AS value,
    unnest([b.hit, b.precision, b.recall, b.f1, b.ndcg, b.ap, b.ap, b.rr]::DOUBLE[]) AS base
  FROM metrics m JOIN base_metrics b USING (question_id, k)),
two AS (SELECT question_type AS grp, k, metric, avg(value) AS value, avg(base) AS base FROM flat JOIN asked USING (question_id)
  WHERE metric <> 'mrr' OR k = 20 GROUP BY ALL
UNION ALL SELECT question_type, 0, 'questions', count(*), count(*) FROM asked GROUP BY question_type
UNION ALL SELECT question_type, 0, 'average_latency_ms', avg(latency_ms), avg(latency_ms) FROM asked GROUP BY question_type)
SELECT grp AS "group", metric, k, round(value, 9) AS value,
  round(round(value, 12) - CASE WHEN grp <> 'machinery' THEN round(base, 12) END, 4) AS delta FROM two""")
def g15(spark, sf):
    current = type_metrics(spark, sf, V.ranking(spark, sf))
    baseline = type_metrics(spark, sf, other_ranking(spark, sf)).withColumn("value", F.when(F.col("group") != "machinery", F.col("value")))
    return summaries.metric_delta(current, baseline, ["group", "metric", "k"]).select(
        "group", "metric", "k", F.round("value", 9).alias("value"), "delta")


def winner_records(spark, sf):
    asked, ranked, gold = inputs(spark, sf)

    def record(order, run_id, rows):
        found = metrics.question_metrics(asked, rows, gold, KS)

        def at(name, k):
            return F.round(F.avg(F.when(F.col("k") == k, F.col(name))), 4)

        return found.agg(at("recall", 10).alias("recall_10"), F.lit(0.0).alias("coverage_10"), at("hit", 5).alias("hit_5"),
                         at("rr", 20).alias("mrr"), at("ndcg", 10).alias("ndcg_10")).select(
            F.lit(order).alias("run_order"), F.lit(run_id).alias("run_id"), F.lit(20).alias("mrr_k"), "*")

    return record(1, "dearest", ranked).unionByName(record(2, "cheapest", other_ranking(spark, sf)))


@query("g16_select_winner", TWO_RUNS + """,
runs AS (SELECT 1 AS o, 'dearest' AS run_id, * FROM metrics UNION ALL SELECT 2, 'cheapest', * FROM base_metrics),
recs AS (SELECT o, run_id, round(avg(recall) FILTER (k = 10), 4) AS recall_10, 0.0::DOUBLE AS coverage_10,
  round(avg(hit) FILTER (k = 5), 4) AS hit_5, round(avg(rr) FILTER (k = 20), 4) AS mrr,
  round(avg(ndcg) FILTER (k = 10), 4) AS ndcg_10 FROM runs GROUP BY ALL)
SELECT run_id, recall_10, coverage_10, hit_5, mrr, ndcg_10 FROM recs
ORDER BY recall_10 DESC, coverage_10 DESC, hit_5 DESC, mrr DESC, ndcg_10 DESC, o LIMIT 1""")
def g16(spark, sf):
    return summaries.select_winner(winner_records(spark, sf))


V.SQL["attempts"] = """
SELECT user_id::VARCHAR AS request_id, event_id AS attempt_id,
  CASE WHEN event_type = 'view' THEN value END AS dense_ms, CASE WHEN event_type = 'click' THEN value END AS bm25_ms,
  CASE WHEN event_type = 'purchase' THEN value END AS rrf_ms, CASE WHEN event_type = 'error' THEN value END AS rerank_ms,
  value AS elapsed_ms FROM events"""


def attempts(spark, sf):
    def of(kind):
        return F.when(F.col("event_type") == kind, F.col("value"))

    return V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("attempt_id"),
        of("view").alias("dense_ms"), of("click").alias("bm25_ms"), of("purchase").alias("rrf_ms"),
        of("error").alias("rerank_ms"), F.col("value").alias("elapsed_ms"))


@query("g18_stage_totals", V.ctes("attempts") + """
SELECT request_id, count(*) AS attempts, round(sum(coalesce(dense_ms, 0)), 4) AS dense_ms,
  round(sum(coalesce(bm25_ms, 0)), 4) AS bm25_ms, round(sum(coalesce(rrf_ms, 0)), 4) AS rrf_ms,
  round(sum(coalesce(rerank_ms, 0)), 4) AS rerank_ms, round(sum(elapsed_ms), 4) AS elapsed_ms
FROM attempts GROUP BY ALL""")
def g18(spark, sf):
    totals = diagnostics.stage_totals(attempts(spark, sf))
    return totals.select("request_id", "attempts", *[F.round(s, 4).alias(s) for s in diagnostics.STAGES])


@query("g19_latency_percentiles", """
SELECT event_type AS stage, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY ALL""")
def g19(spark, sf):
    times = V.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    found = diagnostics.latency_percentiles(times, exact=True)
    return found.select("stage", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")])


CITED = V.ctes("purchases", "asked", "ranking", "returned") + """,
cited AS (SELECT 'doc' AS level, question_id, item_id FROM ranking WHERE rank <= 5
  UNION ALL SELECT 'chunk', question_id, item_id FROM ranking WHERE rank <= 3),
good AS (SELECT DISTINCT level, question_id FROM cited SEMI JOIN returned USING (question_id, item_id))
SELECT level, count(*) AS questions, round(avg((good.question_id IS NOT NULL)::INTEGER), 6) AS accuracy
FROM (SELECT question_id, unnest(['doc', 'chunk']) AS level FROM asked) LEFT JOIN good USING (level, question_id) GROUP BY ALL"""


@query("g20_citation_accuracy", CITED)
def g20(spark, sf):
    asked, ranked, gold = inputs(spark, sf)

    def cited(level, n):
        return ranked.filter(F.col("rank") <= n).select(F.lit(level).alias("level"), "question_id", "item_id")

    both = gold.select(F.explode(F.array(F.lit("doc"), F.lit("chunk"))).alias("level"), "question_id", "item_id")
    found = diagnostics.citation_accuracy(asked, cited("doc", 5).unionByName(cited("chunk", 3)), both)
    return found.withColumn("accuracy", F.round("accuracy", 6))


# answers cite every order line of a customer; chunk = part and line, document = part
V.SQL["selected"] = """
SELECT question_id, rank AS doc_order, CASE WHEN l_returnflag = 'R' THEN '' ELSE item_id || '-' || l_orderkey END AS parent_chunk_id,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 's' || item_id END AS source_id, item_id AS parent_doc_id,
  CASE WHEN l_discount > 0.05 THEN ' ' ELSE o_orderpriority || ' ' || item_id END AS text, 'child ' || o_orderpriority AS child_text
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY l_extendedprice DESC, l_orderkey, item_id) AS rank FROM purchases)"""
V.SQL["source_rows"] = """
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY l_orderkey, item_id, l_extendedprice) AS source_order,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE item_id || '-' || l_orderkey END AS parent_chunk_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 's' || item_id END AS source_id, item_id AS parent_doc_id FROM purchases"""


def selected(spark, sf):
    order = V.Window.partitionBy("question_id").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "item_id")
    chunk = F.concat_ws("-", "item_id", "l_orderkey")
    return V.purchases(spark, sf).withColumn("doc_order", F.row_number().over(order)).select(
        "question_id", "doc_order", F.when(F.col("l_returnflag") == "R", "").otherwise(chunk).alias("parent_chunk_id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("s"), "item_id")).alias("source_id"),
        F.col("item_id").alias("parent_doc_id"),
        F.when(F.col("l_discount") > 0.05, " ").otherwise(F.concat_ws(" ", "o_orderpriority", "item_id")).alias("text"),
        F.concat(F.lit("child "), "o_orderpriority").alias("child_text"))


def source_rows(spark, sf):
    order = V.Window.partitionBy("question_id").orderBy("l_orderkey", "item_id", "l_extendedprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return V.purchases(spark, sf).select(
        "question_id", F.row_number().over(order).alias("source_order"),
        F.when(urgent, "").otherwise(F.concat_ws("-", "item_id", "l_orderkey")).alias("parent_chunk_id"),
        F.when(urgent, "").otherwise(F.concat(F.lit("s"), "item_id")).alias("source_id"),
        F.col("item_id").alias("parent_doc_id"))


@query("g21_final_contexts", V.ctes("purchases", "selected", "source_rows") + """,
exact AS (SELECT question_id, key, min(doc_order) AS doc_order FROM (
  SELECT question_id, parent_chunk_id AS key, doc_order FROM selected UNION ALL
  SELECT question_id, source_id, doc_order FROM selected) WHERE key <> '' GROUP BY ALL),
bydoc AS (SELECT question_id, parent_doc_id AS key, min(doc_order) AS doc_order FROM selected GROUP BY ALL),
chosen AS (SELECT s.question_id, source_order, coalesce(c.doc_order, x.doc_order,
    CASE WHEN s.parent_chunk_id = '' AND s.source_id = '' THEN d.doc_order END) AS doc_order
  FROM source_rows s LEFT JOIN exact c ON c.question_id = s.question_id AND c.key = s.parent_chunk_id
  LEFT JOIN exact x ON x.question_id = s.question_id AND x.key = s.source_id
  LEFT JOIN bydoc d ON d.question_id = s.question_id AND d.key = s.parent_doc_id),
texts AS (SELECT question_id, coalesce(nullif(trim(text), ''), child_text) AS context, min(c.source_order) AS source_order
  FROM chosen c JOIN selected USING (question_id, doc_order) GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY source_order)::INTEGER AS position, context FROM texts""")
def g21(spark, sf):
    return judging.final_contexts(selected(spark, sf), source_rows(spark, sf))


# one answer per order; lines score the judge metrics in turn, a discount of 10 % is no number
METRIC_LIST = ", ".join(f"'{m}'" for m in judging.model.JUDGE_METRICS)
V.SQL["judged"] = f"""
SELECT l_orderkey, map_from_entries(list((list_extract([{METRIC_LIST}], (l + 1)::INTEGER),
  CASE WHEN d = 0.1 THEN 'n/a' ELSE d::VARCHAR END) ORDER BY l)) AS scores
FROM (SELECT l_orderkey, (l_linenumber - 1) % 5 AS l, max(l_discount) AS d FROM lineitem GROUP BY ALL) GROUP BY ALL"""
V.SQL["records"] = """
SELECT o_orderkey::VARCHAR AS question_id, o_totalprice AS latency_ms,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' END AS generation_error FROM orders"""
V.SQL["attached"] = f"""
SELECT question_id, latency_ms, generation_error, CASE WHEN generation_error IS NULL AND len(map_keys(numeric)) > 0 THEN numeric END AS judge_scores,
  CASE WHEN generation_error IS NOT NULL THEN NULL WHEN numeric IS NULL THEN 'RAGAS returned fewer results than samples'
    WHEN len(map_keys(numeric)) = 0 THEN 'RAGAS returned no numeric scores'
    WHEN len(map_keys(numeric)) < 5 THEN 'RAGAS missing metrics: ' || array_to_string(list_filter([{METRIC_LIST}],
      lambda m: NOT list_contains(map_keys(numeric), m)), ', ') END AS judge_error
FROM records LEFT JOIN (SELECT l_orderkey::VARCHAR AS question_id, map_from_entries(list_filter(list_transform(map_entries(scores),
  lambda e: (e.key, try_cast(e.value AS DOUBLE))), lambda e: e[2] IS NOT NULL)) AS numeric FROM judged) USING (question_id)"""


def judged_records(spark, sf):
    names = F.array(*[F.lit(m) for m in judging.model.JUDGE_METRICS])
    lines = V.table(spark, sf, "lineitem").groupBy("l_orderkey", ((F.col("l_linenumber") - 1) % 5).alias("l")).agg(
        F.max("l_discount").alias("d"))
    value = F.when(F.col("d") == 0.1, "n/a").otherwise(F.col("d").cast("string"))
    entry = F.struct(F.get(names, F.col("l")).alias("key"), value.alias("value"))
    scores = lines.groupBy(F.col("l_orderkey").cast("string").alias("question_id")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("scores"))
    records = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("question_id"), F.col("o_totalprice").alias("latency_ms"),
        F.when(F.col("o_orderstatus") == "P", "failed").alias("generation_error"))
    return judging.attach_judge_scores(records, scores)


@query("g22_attach_judge_scores", V.ctes("judged", "records", "attached") + """
SELECT question_id, judge_error, len(map_keys(judge_scores))::INTEGER AS n_scores,
  judge_scores['faithfulness'] AS faithfulness FROM attached""")
def g22(spark, sf):
    return judged_records(spark, sf).select(
        "question_id", "judge_error", F.size(F.map_keys("judge_scores")).alias("n_scores"),
        F.col("judge_scores")["faithfulness"].alias("faithfulness"))


@query("g23_judge_summary", V.ctes("judged", "records", "attached") + f""",
tot AS (SELECT count(*) AS questions, count(*) FILTER (len(map_keys(judge_scores)) = 5) AS valid,
  count(*) FILTER (generation_error IS NOT NULL OR judge_error IS NOT NULL) AS failures, round(avg(latency_ms), 4) AS average_latency_ms FROM attached),
per AS (SELECT metric, round(avg(judge_scores[metric]), 4) AS value, count(judge_scores[metric]) AS coverage
  FROM attached CROSS JOIN (SELECT unnest([{METRIC_LIST}]) AS metric) GROUP BY metric)
SELECT questions, questions AS intended, valid, failures, average_latency_ms,
  CASE WHEN valid / questions >= 0.8 THEN 'complete' ELSE 'incomplete' END AS status,
  metric, value, coverage, round(coverage / questions, 4) AS coverage_rate FROM tot, per""")
def g23(spark, sf):
    return judging.judge_summary(judged_records(spark, sf))


# a case per conversation: the terms are the first two words of its first message
def memory_cases(spark, sf):
    talk = V.table(spark, sf, "conversations")
    words = F.slice(F.filter(F.split(F.lower(F.col("text")), r"\s+"), lambda w: w != ""), 1, 2)
    first = talk.filter("turn = 0").select(
        F.col("conv_id").cast("string").alias("case_id"), F.when(F.col("role") == "user", "user").otherwise("other").alias("category"),
        words.alias("expected_memory_terms"), F.slice(words, 1, 1).alias("expected_answer_terms"),
        (F.col("conv_id") % 3 == 0).alias("delete_after"))
    said = talk.select(F.col("conv_id").cast("string").alias("case_id"), "role", "turn", F.col("text").alias("memory"))
    answers = said.filter("role = 'assistant'").groupBy("case_id").agg(F.max_by("memory", "turn").alias("answer"))
    return judging.memory_case_results(
        first, said.filter("role = 'user'").select("case_id", "memory"), answers,
        said.filter("role = 'assistant'").select("case_id", "memory"), said.filter("role = 'system'").select("case_id", "memory"))


V.SQL["cases"] = r"""
SELECT conv_id::VARCHAR AS case_id, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS category,
  list_slice(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), 1, 2) AS terms,
  conv_id % 3 = 0 AS delete_after FROM conversations WHERE turn = 0"""
V.SQL["case_results"] = """
SELECT case_id, category, delete_after, search_pass, answer_pass, CASE WHEN delete_after THEN search_pass AND NOT still END AS delete_pass,
  NOT leaked AS isolation_pass, search_pass AND answer_pass AND coalesce(CASE WHEN delete_after THEN search_pass AND NOT still END, true)
  AND NOT leaked AS passed
FROM (SELECT c.case_id, category, delete_after,
  coalesce(bool_or(role = 'user' AND hit), false) AS search_pass, coalesce(bool_or(role = 'assistant' AND hit), false) AS still,
  coalesce(bool_or(role = 'system' AND hit), false) AS leaked,
  len(terms) = 0 OR coalesce(contains(replace(lower(arg_max(text, turn) FILTER (role = 'assistant')), ' ', ''), any_value(terms)[1]), false) AS answer_pass
  FROM cases c JOIN (SELECT conv_id::VARCHAR AS case_id, turn, role, text FROM conversations) USING (case_id),
  LATERAL (SELECT list_bool_and(list_transform(terms, lambda t: contains(replace(lower(text), ' ', ''), t))) AS hit)
  GROUP BY c.case_id, category, delete_after, terms)"""


@query("g24_memory_case_results", V.ctes("cases", "case_results") + " SELECT * FROM case_results")
def g24(spark, sf):
    return memory_cases(spark, sf)


@query("g25_memory_eval_summary", V.ctes("cases", "case_results") + """
SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INTEGER), 4) AS pass_rate,
  round(avg(search_pass::INTEGER), 4) AS memory_search_hit_rate, round(avg(answer_pass::INTEGER), 4) AS answer_hit_rate,
  round(avg(delete_pass::INTEGER), 4) AS delete_pass_rate, round(avg(isolation_pass::INTEGER), 4) AS isolation_pass_rate
FROM case_results""")
def g25(spark, sf):
    return judging.memory_eval_summary(memory_cases(spark, sf))


# dense channel: dearest parts; bm25 channel: best discounts; fused: both cut to 40; reranked and cited: fewer
V.SQL["stages"] = """
SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY l_extendedprice DESC, l_orderkey, item_id) AS a,
  row_number() OVER (PARTITION BY question_id ORDER BY l_discount DESC, l_orderkey, item_id) AS b FROM purchases"""


@query("g26_attribute_failures", V.ctes("purchases", "asked", "returned", "stages") + """,
flags AS (SELECT question_id, bool_or(a <= 8) AS d, bool_or(b <= 6) AS m, bool_or((a <= 8 OR b <= 6) AND a <= 20) AS f,
  bool_or(a <= 6) AS r, bool_or(a = 1) AS t, bool_or(a <= 4) AS s FROM stages SEMI JOIN returned USING (question_id, item_id) GROUP BY ALL)
SELECT question_id, failure_type FROM (SELECT question_id, CASE WHEN NOT d AND NOT m THEN 'missed_all_gold' WHEN NOT f THEN 'fusion_dropped_gold'
  WHEN NOT r THEN 'context_budget_dropped_gold' WHEN NOT s THEN 'citation_not_gold' WHEN NOT t THEN 'reranker_top1_not_gold'
  WHEN NOT d THEN 'dense_missed_bm25_hit' WHEN NOT m THEN 'bm25_missed_dense_hit' END AS failure_type FROM flags) WHERE failure_type IS NOT NULL""")
def g26(spark, sf):
    asked, dear, gold = inputs(spark, sf)
    order = V.Window.partitionBy("question_id").orderBy(F.col("l_discount").desc(), "l_orderkey", "item_id")
    both = V.purchases(spark, sf).withColumn("b", F.row_number().over(order)).withColumn(
        "a", F.row_number().over(V.Window.partitionBy("question_id").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "item_id")))

    def stage(condition):
        return both.filter(condition).select("question_id", "item_id", F.col("a").alias("rank"))

    return diagnostics.attribute_failures(asked, gold, stage("a <= 8"), stage("b <= 6"), stage("(a <= 8 OR b <= 6) AND a <= 20"),
                                          stage("a <= 6"), stage("a <= 4"))


@query("g27_chunk_level_metrics", V.ctes("purchases", "asked", "ranking", "returned") + """,
lists AS (SELECT 'chunk' AS level, question_id, item_id || '#' || rank AS item, rank FROM ranking
  UNION ALL SELECT 'doc', question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) FROM ranking GROUP BY question_id, item_id),
goals AS (SELECT 'doc' AS level, question_id, item_id AS item FROM returned UNION ALL
  SELECT 'chunk', question_id, item_id || '#' || rank FROM ranking SEMI JOIN returned USING (question_id, item_id)),
n AS (SELECT level, question_id, count(*) AS n FROM goals GROUP BY ALL),
h AS (SELECT level, question_id, rank FROM lists JOIN goals USING (level, question_id, item))
SELECT level, question_id, k, (count(rank) FILTER (rank <= k) > 0)::INTEGER AS hit, round(count(rank) FILTER (rank <= k) / k, 6) AS precision,
  round(CASE WHEN any_value(n) > 0 THEN count(rank) FILTER (rank <= k) / any_value(n) ELSE 0 END, 6) AS recall
FROM (SELECT question_id, unnest(['doc', 'chunk']) AS level FROM asked) CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS k)
LEFT JOIN n USING (level, question_id) LEFT JOIN h USING (level, question_id) GROUP BY level, question_id, k""")
def g27(spark, sf):
    asked, ranked, gold = inputs(spark, sf)
    chunks = ranked.select("question_id", F.concat_ws("#", "item_id", "rank").alias("chunk_id"), F.col("item_id").alias("doc_id"), "rank")
    chunk_gold = chunks.join(gold.withColumnRenamed("item_id", "doc_id"), ["question_id", "doc_id"], "left_semi").select(
        "question_id", F.col("chunk_id").alias("item_id"))
    found = metrics.chunk_level_metrics(asked, chunks, gold, chunk_gold, KS)
    return found.select("level", "question_id", "k", "hit", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("g28_regression_gate", SUMMED + """, s AS (""" + run_summary_sql("true") + """),
t AS (SELECT 'g' AS g, 'hit' AS metric, 5 AS k, 0.2::DOUBLE AS at_least, NULL::DOUBLE AS at_most UNION ALL SELECT 'g', 'recall', 10, 0.9, NULL
  UNION ALL SELECT 'g', 'average_latency_ms', 0, NULL, 500 UNION ALL SELECT 'g', 'mrr', 7, 0.1, NULL)
SELECT t.metric, t.k, at_least, at_most, s.value, s.value IS NOT NULL AND coalesce(s.value >= at_least, true) AND coalesce(s.value <= at_most, true) AS passed
FROM t LEFT JOIN s ON s.metric = t.metric AND s.k = t.k""")
def g28(spark, sf):
    thresholds = spark.createDataFrame(
        [("hit", 5, 0.2, None), ("recall", 10, 0.9, None), ("average_latency_ms", 0, None, 500.0), ("mrr", 7, 0.1, None)],
        "metric string, k int, at_least double, at_most double")
    return summaries.regression_gate(g09(spark, sf), thresholds).select("metric", "k", "at_least", "at_most", "value", "passed")

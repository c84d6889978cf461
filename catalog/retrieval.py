"""Retrieval queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from catalog import graph as graph_views
from catalog import query
from catalog import views as V
from lodestone.operators import context, dense, filters, fusion, lexical, metrics, postings, rerank, subqueries, webresults
from lodestone.plans import retrieve as plan
from lodestone.session import shared_folder

SQL = V.SQL


@query("d01_bm25_index", V.ctes("items", "toks", "corpus", "posts", "dfs") + """
SELECT term, item_id, tf, dl::INTEGER AS doc_len, df, n AS n_docs, round(avgdl, 6) AS avgdl,
       round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
FROM posts JOIN dfs USING (term), corpus""")
def d01(spark, sf):
    index = lexical.bm25_index(V.items(spark, sf))
    n_docs = index.stats.select("n_docs").scalar()
    avgdl = index.stats.select("avgdl").scalar()
    return index.postings.join(index.terms, "term").select(
        "term", "item_id", "tf", "doc_len", "df", n_docs.alias("n_docs"), F.round(avgdl, 6).alias("avgdl"),
        F.round(lexical.idf(n_docs, F.col("df")), 6).alias("idf"))


@query("d02_bm25_search_children", V.ctes(*V.BM25) + """
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM bm25""")
def d02(spark, sf):
    found = lexical.bm25_search_children(V.questions(spark, sf), V.items(spark, sf), 20)
    return found.withColumn("score", F.round("score", 6))


FLAGSHIP_METRICS = """
flag_ranked AS (SELECT query_id AS question_id, item_id, rank FROM bm25),
flag_hits AS (SELECT question_id, item_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS hit_no
  FROM flag_ranked JOIN passage_gold USING (question_id, item_id)),
flag_expected AS (SELECT question_id, count(*) AS n_expected FROM passage_gold GROUP BY ALL),
flag_counted AS (SELECT q.query_id AS question_id, k, coalesce(any_value(n_expected), 0) AS n_expected,
  count(rank) FILTER (rank <= k) AS n_hits, min(rank) AS first_rank,
  coalesce(sum(hit_no / rank) FILTER (rank <= k), 0) AS ap_sum,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg
  FROM questions q CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS k)
  LEFT JOIN flag_expected e ON e.question_id = q.query_id LEFT JOIN flag_hits h ON h.question_id = q.query_id
  GROUP BY q.query_id, k)"""


@query("flagship_lexical_evaluation", V.ctes(*V.BM25, "passage_keys", "passage_gold") + "," + FLAGSHIP_METRICS
       + ", m AS (" + SQL["metrics"].replace("FROM counted", "FROM flag_counted") + """)
SELECT k, count(*) AS questions, round(avg(hit), 4) AS hit, round(avg(precision), 4) AS precision,
  round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(rr), 4) AS mrr,
  round(avg(ap), 4) AS map, round(avg(ndcg), 4) AS ndcg FROM m GROUP BY k""")
def flagship(spark, sf):
    """B06 → D01 → D02 → G01–G07 → G09: one plan, no Python in it."""
    asked = V.questions(spark, sf)
    ranked = lexical.bm25_search_children(asked, V.items(spark, sf), 20).withColumnRenamed("query_id", "question_id")
    per_question = metrics.question_metrics(
        asked.withColumnRenamed("query_id", "question_id"), ranked, V.passage_gold(spark, sf), V.KS)
    return per_question.groupBy("k").agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(m), 4).alias({"rr": "mrr", "ap": "map"}.get(m, m)) for m in metrics.METRICS])


# ---------------------------------------------------------------- other lexical searches

V.SQL["pitems"] = V.SQL["docs"].replace("doc_id::VARCHAR AS doc_id", "doc_id::VARCHAR AS item_id")
V.SQL["ptexts"] = """
SELECT item_id, title || chr(10) || '' || chr(10) || source_type || chr(10) || content AS text FROM pitems"""
PARENT_CTES = V.bm25_sql("ptexts", "questions", V.PARENT_SQL, 20, drop_empty=True)


def cte_text(parts: dict[str, str]) -> str:
    return ",\n".join(f"{n} AS ({b})" for n, b in parts.items())


@query("d02_bm25_search_stored", V.ctes(*V.BM25) + """
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM bm25""")
def d02_stored(spark, sf):
    """The index is inverted into folders by term, loaded again and searched by blocks."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    postings.save_blocks(lexical.bm25_index(V.items(spark, sf)), folder)
    found = postings.search_blocks(V.questions(spark, sf), postings.BlockIndex.load(spark, folder), 20)
    return found.withColumn("score", F.round("score", 6))


@query("d03_bm25_search_parents", V.ctes("pitems", "ptexts", "questions") + "," + cte_text(PARENT_CTES) + """
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM bm25""")
def d03(spark, sf):
    parents = V.docs(spark, sf).select(F.col("doc_id").alias("item_id"), "title", F.lit("").alias("section_heading"), "source_type", F.col("content").alias("text"))
    return lexical.bm25_search_parents(V.questions(spark, sf), parents, 20).withColumn("score", F.round("score", 6))


def rename(parts: dict[str, str], tag: str) -> dict[str, str]:
    """The same CTEs under names of their own."""
    out = {}
    for name, body in parts.items():
        for other in parts:
            body = re.sub(rf"\b{other}\b", f"{other}_{tag}", body)
        out[f"{name}_{tag}"] = body
    return out


MULTI = {"frows": """
SELECT doc_id::VARCHAR AS item_id, text AS child_text, regexp_extract(text, '^[^\n]*', 0) AS section_heading, """ + V.source_sql("doc_id") + r""" AS source_type,
  regexp_extract(text, '^\s*(\S+(?:\s+\S+){0,4})', 1) AS title, lang AS doc_semantic_type FROM documents""",
         "fquestions": "SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 4 = 0 THEN 'fr' ELSE text END AS query FROM benchmark"}
for field in ("child_text", "title", "section_heading"):
    MULTI[f"in_{field}"] = f"SELECT item_id, {field} AS text FROM frows WHERE {field} <> ''"
    MULTI.update(rename(V.bm25_sql(f"in_{field}", "fquestions", V.CHILD_SQL, None), field))
MULTI["kw"] = """
SELECT query_id, item_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS score FROM frows JOIN fquestions ON query = doc_semantic_type
JOIN (SELECT doc_semantic_type, count(*) AS df FROM frows GROUP BY ALL) USING (doc_semantic_type), (SELECT count(*) AS n FROM frows)"""
MULTI["fields"] = """
SELECT query_id, item_id, max(score) AS score FROM (SELECT query_id, item_id, round(score * 2, 9) AS score FROM scored_child_text UNION ALL
  SELECT query_id, item_id, round(score * 2, 9) FROM scored_title UNION ALL SELECT query_id, item_id, score FROM scored_section_heading UNION ALL SELECT * FROM kw) GROUP BY ALL"""


@query("d04_bm25_multifield", "WITH " + cte_text(MULTI) + """
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fields) WHERE rank <= 20""")
def d04(spark, sf):
    rows = V.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("child_text"), F.regexp_extract("text", r"^[^\n]*", 0).alias("section_heading"),
        V.source_of(F.col("doc_id")).alias("source_type"), F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,4})", 1).alias("title"), F.col("lang").alias("doc_semantic_type"))
    asked = V.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.when(F.col("item_id") % 4 == 0, "fr").otherwise(F.col("text")).alias("query"))
    boosts = {"child_text": 2.0, "title": 2.0, "section_heading": 1.0}
    return lexical.bm25_multifield(asked, rows, 20, boosts).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- dense: the mean vector of each label searches all vectors

def vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"), "embedding", F.col("label").cast("string").alias("label"),
        V.source_of(F.col("vec_id")).alias("source_type"), F.concat(F.lit("group "), F.col("label").cast("string")).alias("title"))


def centroids(spark, sf):
    parts = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one value per dimension of a vector
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return listed.select(F.col("label").alias("query_id"), F.transform("v", lambda e: e["x"]).alias("embedding"))


V.SQL["vecs"] = f"SELECT vec_id::VARCHAR AS item_id, embedding::DOUBLE[] AS e, label::VARCHAR AS label, {V.source_sql('vec_id')} AS source_type, 'group ' || label AS title FROM embeddings"
V.SQL["cents"] = """
SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vecs) GROUP BY ALL) GROUP BY ALL"""
V.SQL["sims"] = "SELECT query_id, item_id, source_type, label, title, round(list_cosine_similarity(q, e), 9) AS score FROM cents, vecs"
V.SQL["knn"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims QUALIFY rank <= 40"
KNN = ["vecs", "cents", "sims", "knn"]


@query("d05_knn_exact", V.ctes(*KNN) + " SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM knn WHERE rank <= 20")
def d05(spark, sf):
    return dense.knn_exact(centroids(spark, sf), vectors(spark, sf), 20).withColumn("score", F.round("score", 6))


@query("d06_knn_approx")
def d06(spark, sf):
    return dense.knn_approx(centroids(spark, sf), vectors(spark, sf), 20).withColumn("score", F.round("score", 6))


@query("d06_knn_recall")
def d06_recall(spark, sf):
    """How much of the exact result the approximate search finds."""
    approximate = dense.knn_approx(centroids(spark, sf), vectors(spark, sf), 20)
    return dense.recall(approximate, dense.knn_exact(centroids(spark, sf), vectors(spark, sf), 20))


# ---------------------------------------------------------------- filters: decisions per question

FILTER_SQL = f"""
SELECT item_id::VARCHAR AS query_id, item_id % 3 AS m, {V.source_sql('item_id')} AS s, substr(text, 1, strpos(text, ' ') - 1) AS w FROM benchmark"""
V.SQL["rules"] = FILTER_SQL


def decisions(spark, sf):
    i = F.col("item_id")
    none = F.array().cast("array<string>")
    first_word = F.substring_index("text", " ", 1)
    return V.table(spark, sf, "benchmark").select(
        i.cast("string").alias("query_id"), F.when(i % 3 == 0, "hard").when(i % 3 == 1, "soft").otherwise("none").alias("mode"),
        F.array(V.source_of(i), V.source_of(i + 1)).alias("source_types"), F.array(F.lit("generic_doc"), F.lit("issue_ticket"), F.lit("chat_thread")).alias("doc_semantic_types"),
        F.when(i % 2 == 0, F.array(first_word)).otherwise(none).alias("title_keywords"), F.array(F.lit("")).alias("section_keywords"),
        F.array(V.source_of(i + 2)).alias("source_hints"), F.lit("by rule").alias("reason"))


def attributes(spark, sf):
    d = V.docs(spark, sf)
    kind = F.when(F.col("source_type") == "slack", "chat_thread").when(F.col("source_type").isin("jira", "linear"), "issue_ticket").otherwise("generic_doc")
    return d.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("c"), F.floor(F.col("doc_id").cast("bigint") / 3)).alias("parent_chunk_id"),
                    F.concat(F.lit("d"), F.floor(F.col("doc_id").cast("bigint") / 6)).alias("parent_doc_id"), "source_type", kind.alias("doc_semantic_type"), "title",
                    F.lit("").alias("section_heading"))


V.SQL["attrs"] = r"""
SELECT doc_id AS item_id, 'c' || doc_id::BIGINT // 3 AS parent_chunk_id, 'd' || doc_id::BIGINT // 6 AS parent_doc_id, source_type,
  CASE WHEN source_type = 'slack' THEN 'chat_thread' WHEN source_type IN ('jira', 'linear') THEN 'issue_ticket' ELSE 'generic_doc' END AS doc_semantic_type, title FROM docs"""
V.SQL["decided"] = f"""
SELECT item_id::VARCHAR AS query_id, CASE item_id % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' ELSE 'none' END AS mode, [{V.source_sql('item_id')}, {V.source_sql('(item_id + 1)')}] AS ss,
  CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] END AS word, {V.source_sql('(item_id + 2)')} AS hint FROM benchmark"""
WORDS = r"regexp_replace(lower({0}), '[^\pL\pN\pM_\s]+', ' ', 'g')"
PADDED = r"(' ' || trim(regexp_replace(" + WORDS + r", '\s+', ' ', 'g')) || ' ')"
ADMITS = f"(mode <> 'hard' OR (list_contains(ss, source_type) AND (word IS NULL OR contains({PADDED.format('title')}, {PADDED.format('word')}))))"


@query("d07_hard_filter", V.ctes(*V.BM25[:-1], "docs", "attrs", "decided") + f"""
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM scored JOIN attrs USING (item_id) JOIN decided USING (query_id) WHERE {ADMITS}) WHERE rank <= 20""")
def d07(spark, sf):
    asked = V.questions(spark, sf)
    corpus = plan.Corpus(V.items(spark, sf).join(attributes(spark, sf), "item_id"))
    return plan.lexical_channel(asked, corpus, 20, decisions(spark, sf)).withColumn("score", F.round("score", 6))


# queries by turns: no rule, sources and titles, a source no list names, a kind alone
@query("d07_hard_filter_dense", V.ctes(*KNN[:3]) + """
SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims
  WHERE CASE query_id::INTEGER % 4 WHEN 0 THEN true WHEN 1 THEN source_type IN ('slack', 'jira') AND item_id::INTEGER % 3 <> 0 AND label IN ('1', '2', '3')
    WHEN 2 THEN item_id::INTEGER % 3 = 0 ELSE item_id::INTEGER % 2 = 0 END) WHERE rank <= 20""")
def d07_dense(spark, sf):
    queries = centroids(spark, sf)
    turn, number, texts = F.col("query_id").cast("int") % 4, F.col("item_id").cast("int"), "array<string>"
    listed = lambda *names: F.array(*[F.lit(n) for n in names]).cast(texts)
    at = lambda n, value: F.when(turn == n, value).otherwise(listed())
    rules = queries.select(
        "query_id", F.when(turn == 0, "none").otherwise("hard").alias("mode"),
        F.when(turn == 2, listed("unlisted")).otherwise(at(1, listed("slack", "jira"))).alias("source_types"), at(3, listed("new kind")).alias("doc_semantic_types"),
        at(1, listed("Group 1", "group 2", "GROUP-3")).alias("title_keywords"), listed().alias("section_keywords"))
    rows = (vectors(spark, sf).withColumn("source_type", F.when(number % 3 == 0, "unlisted").otherwise(F.col("source_type")))
            .withColumn("doc_semantic_type", F.when(number % 2 == 0, "new kind").otherwise("generic_doc")).withColumn("section_heading", F.lit("")))
    return dense.knn_exact(filters.dense_filters(queries, rules), filters.dense_attributes(rows), 20).withColumn("score", F.round("score", 6))


@query("d08_phrase_match", f"""
SELECT page_id, contains({PADDED.format('html')}, ' the of ') OR contains({PADDED.format('html')}, ' lang en ') OR contains({PADDED.format('html')}, ' p margin 0 p ') AS hit FROM pages""")
def d08(spark, sf):
    phrases = F.array(F.lit("The, of"), F.lit("lang=en"), F.lit("p{margin:0} p"), F.lit(""), F.lit(None).cast("string"))
    return V.table(spark, sf, "pages").select("page_id", filters.phrase_match(F.col("html"), phrases).alias("hit"))


# ---------------------------------------------------------------- fusion: BM25 by words and by document length

def bm25_ranked(spark, sf):
    return lexical.bm25_search_children(V.questions(spark, sf), V.items(spark, sf), 20)


def second_ranked(spark, sf):
    """A second channel: documents that share the question's first word, longest first."""
    return lexical.bm25_search(V.questions(spark, sf).withColumn("query", F.substring_index("query", " ", 6)), V.items(spark, sf), 20)


SECOND = rename(V.bm25_sql("items", "short_questions", V.CHILD_SQL, 20), "b")
V.SQL["short_questions"] = "SELECT query_id, array_to_string(list_slice(string_split(query, ' '), 1, 6), ' ') AS query FROM questions"
TWO = V.ctes(*V.BM25, "short_questions") + "," + cte_text(SECOND)
FUSED_SQL = """, lists AS (SELECT query_id, item_id, rank, 'v' AS ch FROM bm25 UNION ALL SELECT query_id, item_id, rank, 'b' FROM bm25_b),
fused AS (SELECT query_id, item_id, round(sum(1 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL)"""


@query("d09_collapse_to_parent", V.ctes(*V.BM25, "docs", "attrs") + """
SELECT query_id, parent_chunk_id, arg_min(item_id, rank) AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank))::INTEGER AS rank, min(rank)::INTEGER AS raw_rank
FROM bm25 JOIN attrs USING (item_id) GROUP BY query_id, parent_chunk_id""")
def d09(spark, sf):
    ranked = bm25_ranked(spark, sf).join(attributes(spark, sf), "item_id")
    raw = fusion.collapse_to_parent(ranked, rerank=False).select("query_id", "parent_chunk_id", F.col("rank").alias("raw_rank"))
    return fusion.collapse_to_parent(ranked).join(raw, ["query_id", "parent_chunk_id"])


@query("d10_rrf_fuse", TWO + FUSED_SQL + """
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM fused""")
def d10(spark, sf):
    return fusion.rrf_fuse({"a": bm25_ranked(spark, sf), "b": second_ranked(spark, sf)})


@query("d11_rrf_fuse_children", TWO + """
SELECT query_id, item_id, a.rank::INTEGER AS vector_rank, round(a.score, 6) AS vector_score, b.rank::INTEGER AS bm25_rank, round(b.score, 6) AS bm25_score,
  round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS fused_score FROM bm25 a FULL JOIN bm25_b b USING (query_id, item_id)""")
def d11(spark, sf):
    fused = fusion.rrf_fuse_children(bm25_ranked(spark, sf), second_ranked(spark, sf))
    return fused.withColumn("vector_score", F.round("vector_score", 6)).withColumn("bm25_score", F.round("bm25_score", 6))


# graph channel: parent chunks of the second list from its tenth place on, reversed, and a parent of no child
GRAPH_SQL = """, child AS (SELECT query_id, item_id, a.rank AS va, b.rank AS vb, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS f FROM bm25 a FULL JOIN bm25_b b USING (query_id, item_id)),
kids AS (SELECT c.*, parent_chunk_id, CASE WHEN doc_semantic_type = 'chat_thread' THEN '' ELSE doc_semantic_type END AS kind FROM child c JOIN attrs USING (item_id)),
hits AS (SELECT query_id, parent_chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS g FROM (SELECT query_id, parent_chunk_id, min(rank) AS r FROM bm25_b JOIN attrs USING (item_id) GROUP BY ALL)),
rep AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY f DESC, least(coalesce(va, 99), coalesce(vb, 99)), item_id) AS p FROM kids)"""


@query("d12_rrf_fuse_graph", TWO + ", docs AS (" + SQL["docs"] + "), attrs AS (" + SQL["attrs"] + ")" + GRAPH_SQL + """
SELECT query_id, item_id, parent_chunk_id, CASE WHEN kind IN ('', 'generic_doc') THEN CASE WHEN g IS NOT NULL THEN 'faq' ELSE 'generic_doc' END ELSE kind END AS doc_semantic_type, g::INTEGER AS graph_rank,
  CASE WHEN g IS NULL THEN '' ELSE parent_chunk_id END AS evidence, round(f + coalesce(1 / (60 + g), 0), 9) AS fused_score
FROM (SELECT k.query_id, k.item_id, k.parent_chunk_id, kind, f, CASE WHEN p = 1 THEN g END AS g FROM rep k LEFT JOIN hits h ON h.query_id = k.query_id AND h.parent_chunk_id = k.parent_chunk_id)
UNION ALL SELECT query_id, parent_chunk_id, parent_chunk_id, 'faq', g::INTEGER, parent_chunk_id, round(1 / (60 + g), 9) FROM hits ANTI JOIN kids USING (query_id, parent_chunk_id)""")
def d12(spark, sf):
    first, second = bm25_ranked(spark, sf), second_ranked(spark, sf)
    attrs = attributes(spark, sf)
    kind = F.when(F.col("doc_semantic_type") == "chat_thread", "").otherwise(F.col("doc_semantic_type"))
    children = fusion.rrf_fuse_children(first, second).join(
        attrs.withColumn("doc_semantic_type", kind), "item_id")
    hits = fusion.collapse_to_parent(second.join(attrs, "item_id"), rerank=False)
    reversed_order = V.Window.partitionBy("query_id").orderBy(F.col("rank").desc())
    graph = hits.withColumn("rank", F.row_number().over(reversed_order)).select(
        "query_id", F.col("parent_chunk_id").alias("item_id"), "parent_chunk_id", F.lit("faq").alias("doc_semantic_type"), "rank",
        F.lit(1.0).alias("score"), F.array("parent_chunk_id").alias("evidence_ids"))
    return fusion.rrf_fuse_graph(children, graph).select(
        "query_id", "item_id", "parent_chunk_id", "doc_semantic_type", "graph_rank", F.array_join("evidence_ids", "|").alias("evidence"), "fused_score")


def fused_rows(spark, sf):
    fused = fusion.rrf_fuse({"a": bm25_ranked(spark, sf), "b": second_ranked(spark, sf)})
    return fused.select("query_id", "item_id", "score").join(attributes(spark, sf), "item_id")


WITH_ATTRS = TWO + FUSED_SQL + ", docs AS (" + SQL["docs"] + "), attrs AS (" + SQL["attrs"] + "), decided AS (" + SQL["decided"] + ")"


@query("d13_boost_sources", WITH_ATTRS + """
SELECT query_id, item_id, round(score * CASE WHEN source_type = hint THEN 1.15 ELSE 1 END, 9) AS score FROM fused JOIN attrs USING (item_id) JOIN decided USING (query_id)""")
def d13(spark, sf):
    return filters.boost_sources(fused_rows(spark, sf), decisions(spark, sf)).select("query_id", "item_id", "score")


@query("d14_soft_boost", WITH_ATTRS + """
SELECT query_id, item_id, round(score * CASE WHEN source_type = hint OR (mode = 'soft' AND (list_contains(ss, source_type) OR doc_semantic_type IN ('issue_ticket', 'chat_thread')
  OR coalesce(contains(lower(title), lower(word)), false))) THEN 1.15 ELSE 1 END, 9) AS score FROM fused JOIN attrs USING (item_id) JOIN decided USING (query_id)""")
def d14(spark, sf):
    rules = decisions(spark, sf).withColumn("doc_semantic_types", F.array(F.lit("issue_ticket"), F.lit("chat_thread")))
    return filters.soft_boost(fused_rows(spark, sf), rules).select("query_id", "item_id", "score")


@query("d15_weighted_ensemble", TWO + """,
w AS (SELECT query_id, CASE WHEN d > 0.1 THEN greatest(v - 0.1, 0.3) ELSE v END AS v, CASE WHEN d > 0.1 THEN least(b + 0.1, 0.7) ELSE b END AS b FROM (
  SELECT query_id, CASE WHEN length(q) > 50 THEN 0.7 WHEN length(q) < 20 THEN 0.3 ELSE 0.5 END::DOUBLE AS v, CASE WHEN length(q) > 50 THEN 0.3 WHEN length(q) < 20 THEN 0.7 ELSE 0.5 END::DOUBLE AS b,
    len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '')) / length(q) AS d FROM (SELECT query_id, left(query, query_id::INTEGER * 3 + 5) AS q FROM questions))),
l AS (SELECT query_id, item_id, v / (60 + rank) AS s FROM bm25 JOIN w USING (query_id) UNION ALL SELECT query_id, item_id, b / (60 + rank) FROM bm25_b JOIN w USING (query_id)),
f AS (SELECT query_id, item_id, round(sum(s), 9) AS score FROM l GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM f""")
def d15(spark, sf):
    asked = V.questions(spark, sf).withColumn("query", F.substring("query", F.lit(1), F.col("query_id").cast("int") * 3 + 5))
    return fusion.weighted_ensemble(bm25_ranked(spark, sf), second_ranked(spark, sf), asked)


@query("d16_top_k", TWO + FUSED_SQL + """
SELECT query_id, item_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fused) WHERE rank <= query_id::INTEGER % 10 + 1""")
def d16(spark, sf):
    fused = fusion.rrf_fuse({"a": bm25_ranked(spark, sf), "b": second_ranked(spark, sf)})
    limits = V.questions(spark, sf).select("query_id", (F.col("query_id").cast("int") % 10 + 1).alias("final_top_k"))
    return fusion.top_k(fused, limits, "final_top_k", 10).select("query_id", "item_id", "rank")


# ---------------------------------------------------------------- reranking on large rankings: a customer's purchases, model score = number of the part

def long_ranked(spark, sf):
    return V.ranking(spark, sf).groupBy("question_id", "item_id").agg(F.min("rank").alias("rank")).withColumnRenamed("question_id", "query_id").withColumn(
        "rank", F.row_number().over(V.Window.partitionBy("query_id").orderBy("rank")))


def model_scores(ranked, missing=None):
    score = F.col("item_id").cast("int") % 101 / 100
    rows = ranked.select("query_id", "item_id", score.alias("score"))
    return rows if missing is None else rows.filter(~missing)


V.SQL["long"] = "SELECT question_id AS query_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) AS rank FROM ranking GROUP BY question_id, item_id"
LONG = V.ctes("purchases", "ranking", "long")


@query("d17_rerank_window", LONG + """
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN item_id::INTEGER % 101 / 100 END DESC, rank)::INTEGER AS rank FROM long""")
def d17(spark, sf):
    ranked = long_ranked(spark, sf)
    return rerank.rerank_window(ranked, model_scores(ranked), 10).select("query_id", "item_id", "rank")


@query("d18_rerank_all", LONG + """
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank)::INTEGER AS rank FROM (
  SELECT *, CASE WHEN query_id::INTEGER % 5 <> 0 AND item_id::INTEGER % 4 <> 0 THEN item_id::INTEGER % 101 / 100 END AS s FROM long) WHERE s IS NOT NULL OR query_id::INTEGER % 5 = 0""")
def d18(spark, sf):
    ranked = long_ranked(spark, sf)
    missing = (F.col("query_id").cast("int") % 5 == 0) | (F.col("item_id").cast("int") % 4 == 0)
    return rerank.rerank_all(ranked, model_scores(ranked, missing)).select("query_id", "item_id", "rank")


# order priorities stand for sub-queries
V.SQL["subranked"] = """
SELECT question_id AS query_id, o_orderpriority AS sub_query_id, item_id, max(CASE WHEN l_discount = 0.1 THEN 0 ELSE l_discount END) AS score, min(l_orderkey % 7 + 1) AS rank FROM purchases GROUP BY ALL"""


def sub_ranked(spark, sf):
    return V.purchases(spark, sf).groupBy(F.col("question_id").alias("query_id"), F.col("o_orderpriority").alias("sub_query_id"), "item_id").agg(
        F.max(F.when(F.col("l_discount") == 0.1, 0.0).otherwise(F.col("l_discount"))).alias("score"), F.min(F.col("l_orderkey") % 7 + 1).alias("rank"))


@query("d19_merge_subqueries_best", V.ctes("purchases", "subranked") + """
SELECT query_id, item_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, item_id)::INTEGER AS rank FROM subranked GROUP BY query_id, item_id""")
def d19(spark, sf):
    return subqueries.merge_subqueries_best(sub_ranked(spark, sf))


@query("d20_merge_subqueries_coverage", V.ctes("purchases", "subranked") + """,
n AS (SELECT query_id, count(DISTINCT sub_query_id) AS n FROM subranked GROUP BY ALL),
f AS (SELECT query_id, item_id, round(max(CASE WHEN score <> 0 THEN score ELSE 1 / rank END) * (1 + 0.25 * count(DISTINCT sub_query_id) / n), 9) AS score, string_agg(DISTINCT sub_query_id, '|' ORDER BY sub_query_id) AS matched
  FROM subranked JOIN n USING (query_id) GROUP BY query_id, item_id, n)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM f""")
def d20(spark, sf):
    rows = sub_ranked(spark, sf)
    merged = subqueries.merge_subqueries_coverage(rows, rows)
    return merged.select("query_id", "item_id", "score", F.array_join("matched_sub_query_ids", "|").alias("matched"), "rank")


@query("d21_dedup_docs", LONG + """
SELECT query_id, 'd' || item_id::INTEGER // 40 AS parent_doc_id, arg_min(item_id, rank) AS item_id, min(rank)::INTEGER AS raw_child_rank, row_number() OVER (PARTITION BY query_id ORDER BY min(rank))::INTEGER AS rank
FROM long WHERE item_id::INTEGER >= 40 GROUP BY query_id, item_id::INTEGER // 40""")
def d21(spark, sf):
    return fusion.dedup_docs(with_docs(long_ranked(spark, sf)))


def with_docs(ranked):
    number = F.col("item_id").cast("int")
    return ranked.withColumn("parent_doc_id", F.when(number < 40, "").otherwise(F.concat(F.lit("d"), F.floor(number / 40))))


@query("d22_coverage_order", LONG + """,
l AS (SELECT *, CASE WHEN item_id::INTEGER < 40 THEN '' ELSE 'd' || item_id::INTEGER // 40 END AS doc FROM long),
heads AS (SELECT query_id, doc, arg_min(item_id, rank) AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank) DESC) AS rank FROM l WHERE doc <> '' GROUP BY query_id, doc)
SELECT query_id, item_id, rank::INTEGER AS rank FROM l WHERE query_id::INTEGER % 2 = 1 UNION ALL
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY p, rank)::INTEGER FROM (
  SELECT query_id, item_id, 0 AS p, rank FROM heads WHERE query_id::INTEGER % 2 = 0 UNION ALL
  SELECT l.query_id, l.item_id, 1, l.rank FROM l ANTI JOIN heads h ON h.query_id = l.query_id AND h.item_id = l.item_id WHERE doc <> '' AND query_id::INTEGER % 2 = 0)""")
def d22(spark, sf):
    ranked = with_docs(long_ranked(spark, sf))
    heads = fusion.dedup_docs(ranked)
    turned = heads.withColumn("rank", F.row_number().over(V.Window.partitionBy("query_id").orderBy(F.col("rank").desc())))
    even = ranked.select("query_id").distinct().filter(F.col("query_id").cast("int") % 2 == 0)
    return rerank.coverage_order(ranked, turned, even)


# ---------------------------------------------------------------- contexts and sources

V.SQL["chosen"] = "SELECT query_id, attrs.item_id, rank, attrs.source_type, doc_semantic_type, attrs.title, parent_doc_id, parent_chunk_id, content AS text FROM bm25 JOIN attrs USING (item_id) JOIN docs ON doc_id = item_id"


def chosen(spark, sf):
    texts = V.docs(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("content").alias("text"))
    return bm25_ranked(spark, sf).join(attributes(spark, sf), "item_id").join(texts, "item_id")


@query("d23_pack_context", V.ctes(*V.BM25, "docs", "attrs", "chosen") + """
SELECT query_id, md5(string_agg('【资料' || rank || '】' || chr(10) || 'source_type: ' || source_type || chr(10) || 'doc_semantic_type: ' || doc_semantic_type || chr(10) || 'title: ' || title || chr(10) || 'section: ' || chr(10)
  || 'parent_doc_id: ' || parent_doc_id || chr(10) || 'content:' || chr(10) || left(text, 2500), chr(10) || chr(10) ORDER BY rank)) AS context FROM chosen GROUP BY ALL""")
def d23(spark, sf):
    return context.pack_context(chosen(spark, sf), 2500).withColumn("context", F.md5("context"))


@query("d23_pack_memories", r"""
SELECT conv_id::VARCHAR AS query_id, md5(string_agg((turn + 1) || '. [' || role || '] ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn)) AS memory_context
FROM conversations WHERE turn < 5 AND trim(text) <> '' GROUP BY ALL""")
def d23_memories(spark, sf):
    recalled = V.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("category"), F.col("text").alias("memory"))
    return context.pack_memories(recalled, 5).withColumn("memory_context", F.md5("memory_context"))


@query("d24_merge_sources", V.ctes(*V.BM25) + """,
web AS (SELECT (page_id % 40)::VARCHAR AS query_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS rank, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'T' || page_id END AS title FROM pages),
joined AS (SELECT query_id, 0 AS b, rank, item_id AS source_id, 'doc ' || item_id AS title, 'kb' AS source_type FROM bm25 UNION ALL
  SELECT query_id, 1, rank, 'web:' || coalesce(nullif(url, ''), nullif(title, ''), 'result'), coalesce(nullif(title, ''), nullif(url, ''), 'Web reference'), 'web_reference' FROM web)
SELECT query_id, source_id, title, source_type, row_number() OVER (PARTITION BY query_id ORDER BY b, rank, source_id)::INTEGER AS position FROM joined""")
def d24(spark, sf):
    p = F.col("page_id")
    web = V.table(spark, sf, "pages").select(
        (p % 40).cast("string").alias("query_id"), F.row_number().over(V.Window.partitionBy(p % 40).orderBy(p)).alias("rank"),
        F.when(p % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("T"), p)).alias("title"))
    internal = bm25_ranked(spark, sf).select("query_id", "rank", F.col("item_id").alias("source_id"), F.concat(F.lit("doc "), "item_id").alias("title"), F.lit("kb").alias("source_type"))
    return webresults.merge_sources(internal, web)


V.SQL["fact_questions"] = """
SELECT conv_id::VARCHAR AS query_id, CASE conv_id % 3 WHEN 0 THEN 'multi_hop' WHEN 1 THEN 'comparison' ELSE 'semantic' END AS question_type, 'ask ' || conv_id AS query,
  list(CASE WHEN turn % 3 = 1 THEN '  ' ELSE ' ' || left(text, 30) END ORDER BY turn) AS facts FROM conversations GROUP BY conv_id"""


def fact_questions(spark, sf):
    fact = F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), F.substring("text", 1, 30)))
    kind = F.when(F.col("conv_id") % 3 == 0, "multi_hop").when(F.col("conv_id") % 3 == 1, "comparison").otherwise("semantic")
    listed = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", fact.alias("f")))).alias("fs"))
    return listed.select(F.col("conv_id").cast("string").alias("query_id"), kind.alias("question_type"), F.concat(F.lit("ask "), "conv_id").alias("query"),
                         F.transform("fs", lambda x: x["f"]).alias("answer_facts"))


@query("d25_expand_queries", V.ctes("fact_questions") + """,
c AS (SELECT query_id, question_type, query, list_slice(list_filter(list_transform(facts, lambda f: trim(f)), lambda f: f <> ''), 1, 4) AS f FROM fact_questions),
p AS (SELECT query_id, question_type, CASE WHEN question_type <> 'semantic' AND len(f) > 0 THEN f ELSE [query] END AS f FROM c)
SELECT query_id, question_type, unnest(f) AS query, 'sq' || generate_subscripts(f, 1) AS sub_query_id FROM p""")
def d25(spark, sf):
    return subqueries.expand_queries(fact_questions(spark, sf), 4)


@query("d26_rewrite_queries", f"""
SELECT item_id::VARCHAR AS query_id, trim(text || ' ' || CASE WHEN item_id % 2 = 0 THEN {V.source_sql('item_id')} || ' wiki' ELSE '' END || ' enterprise knowledge evidence') AS query FROM benchmark""")
def d26(spark, sf):
    i = F.col("item_id")
    rows = V.table(spark, sf, "benchmark").select(i.cast("string").alias("query_id"), F.col("text").alias("query"),
                                                  F.when(i % 2 == 0, F.array(V.source_of(i), F.lit("wiki"))).alias("source_hints"))
    return subqueries.rewrite_queries(rows).select("query_id", "query")


@query("d27_substitute_queries", "SELECT b.item_id::VARCHAR AS query_id, coalesce(nullif(d.text, ''), b.text) AS query FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def d27(spark, sf):
    given = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("query_id"), "text")
    return subqueries.substitute_queries(V.questions(spark, sf), given).select("query_id", "query")


@query("d29_answer_sources", V.ctes(*V.BM25, "docs", "attrs") + """
SELECT query_id, rank::INTEGER AS position, CASE WHEN b.item_id::INTEGER % 3 = 0 THEN CASE WHEN b.item_id::INTEGER % 2 = 0 THEN a.title ELSE a.parent_doc_id END ELSE a.parent_chunk_id END AS source_id, left(content, 500) AS snippet
FROM bm25 b JOIN attrs a ON a.item_id = b.item_id JOIN docs d ON d.doc_id = b.item_id WHERE rank <= 5""")
def d29(spark, sf):
    number = F.col("item_id").cast("int")
    rows = chosen(spark, sf).withColumn("parent_chunk_id", F.when(number % 3 == 0, "").otherwise(F.col("parent_chunk_id"))).withColumn(
        "parent_doc_id", F.when((number % 3 == 0) & (number % 2 == 0), "").otherwise(F.col("parent_doc_id")))
    return context.answer_sources(rows, 5, 500).select("query_id", "position", "source_id", "snippet")


# every customer asks for its purchases; order priority is the knowledge base, one status is public
def acl_rows(spark, sf):
    orders = V.table(spark, sf, "orders")
    rows = orders.select(
        (F.col("o_custkey")).cast("string").alias("query_id"), F.col("o_orderkey").cast("string").alias("item_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 50).alias("owner_user_id"),
        F.col("o_orderpriority").alias("knowledge_base_id"), F.when(F.col("o_totalprice") > 450000, "enterprise_public").otherwise("private").alias("visibility"))
    queries = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("query_id"), F.concat(F.lit("u"), F.col("c_custkey") % 50).alias("user_id"))
    own = F.when(F.col("o_custkey") % 50 % 2 == 0, "1-URGENT").otherwise("5-LOW")
    base = F.when((F.col("o_custkey") % 7 == 0) & (F.col("o_orderpriority") == own), F.col("o_orderpriority")).otherwise("closed")
    grants = orders.select(F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("user_id"), base.alias("knowledge_base_id"))
    return rows, queries, grants


V.SQL["acl"] = """
SELECT o.o_custkey::VARCHAR AS query_id, o.o_orderkey::VARCHAR AS item_id, o.o_orderkey % 50 = o.o_custkey % 50 OR o.o_totalprice > 450000 OR
  (o.o_custkey % 50, o.o_orderpriority) IN (SELECT (o_custkey % 50, o_orderpriority) FROM orders WHERE o_custkey % 7 = 0 AND o_orderpriority = CASE WHEN o_custkey % 50 % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END) AS sees FROM orders o"""


@query("d30_acl_filter", V.ctes("acl") + " SELECT query_id, item_id FROM acl WHERE sees")
def d30(spark, sf):
    return filters.acl_filter(*acl_rows(spark, sf)).select("query_id", "item_id")


@query("d30_acl_removed_all", V.ctes("acl") + " SELECT query_id FROM acl GROUP BY ALL HAVING NOT bool_or(sees)")
def d30_flag(spark, sf):
    rows, queries, grants = acl_rows(spark, sf)
    return filters.acl_removed_all(rows, filters.acl_filter(rows, queries, grants))


# ---------------------------------------------------------------- whole methods; document and vector share a number, a question searches with the mean vector of one label

def corpus(spark, sf):
    children = V.items(spark, sf).join(attributes(spark, sf), "item_id")
    return plan.Corpus(children, vectors(spark, sf).select("item_id", "embedding"), None, None)


def full_questions(spark, sf):
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "multi_hop").when(i % 3 == 1, "semantic").otherwise("lookup")
    return V.table(spark, sf, "benchmark").select(
        i.cast("string").alias("query_id"), F.col("text").alias("query"), kind.alias("question_type"), F.array(V.source_of(i)).alias("source_types"),
        F.split("text", r"\.\s").alias("answer_facts"))


def models(spark, sf):
    means = centroids(spark, sf).select(F.col("query_id").alias("label"), "embedding")

    def embed(queries):
        return queries.select("query_id", F.pmod(F.split("query_id", "\u0001")[0].cast("int"), F.lit(10)).cast("string").alias("label")).join(means, "label").select("query_id", "embedding")

    def score(pairs):
        return pairs.select("query_id", "item_id", (F.length("text") % 997 / 997).alias("score"))

    return plan.Models(embed, score)


def method_query(name, method, sql=None, with_rules=False):
    @query(name, sql)
    def run(spark, sf):
        found = plan.retrieve(method, full_questions(spark, sf), corpus(spark, sf), models(spark, sf), 30, decisions=decisions(spark, sf) if with_rules else None)
        return found.documents.filter("rank <= 20").select("query_id", "item_id", "parent_doc_id", "rank")


V.SQL["rknn"] = """
SELECT b.item_id::VARCHAR AS query_id, s.item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY s.score DESC, s.item_id) AS rank FROM benchmark b JOIN sims s ON s.query_id = (b.item_id % 10)::VARCHAR QUALIFY rank <= 30"""
V.SQL["rbm"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored QUALIFY rank <= 30"
V.SQL["rfused"] = "SELECT query_id, item_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM rknn UNION ALL SELECT query_id, item_id, rank FROM rbm) GROUP BY ALL"
V.SQL["rdocs"] = """
SELECT query_id, parent_doc_id, arg_min(item_id, r) AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS rank FROM (SELECT query_id, r.item_id, parent_doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, r.item_id) AS r
  FROM rfused r LEFT JOIN attrs USING (item_id)) WHERE parent_doc_id IS NOT NULL GROUP BY query_id, parent_doc_id"""
METHOD_CTES = V.ctes(*V.BM25[:-1], "docs", "attrs", "vecs", "cents", "sims", "rknn", "rbm", "rfused")
BOOSTED = f"CASE WHEN source_type = {V.source_sql('query_id::BIGINT')} THEN round(score * 1.15, 9) ELSE score END"
LAST = " SELECT query_id, item_id, parent_doc_id, rank::INTEGER AS rank FROM rdocs WHERE rank <= 20"

method_query("d28_retrieve_chroma_bm25_rrf", "chroma_bm25_rrf", METHOD_CTES + ", rdocs AS (" + V.SQL["rdocs"].format(score="score") + ")" + LAST)
method_query("d28_retrieve_source_boost", "chroma_bm25_rrf_source_boost", METHOD_CTES + ", rdocs AS (" + V.SQL["rdocs"].format(score=BOOSTED) + ")" + LAST)
method_query("d28_retrieve_reranker", "hybrid_bm25_rrf_reranker", METHOD_CTES + ", rdocs AS (" + V.SQL["rdocs"].format(score="score") + """)
SELECT query_id, r.item_id, parent_doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 20 DESC, CASE WHEN rank <= 20 THEN length(left(text, 4000)) % 997 / 997 END DESC, rank)::INTEGER AS rank
FROM rdocs r JOIN items USING (item_id) QUALIFY rank <= 20 AND row_number() OVER (PARTITION BY query_id ORDER BY rank <= 20 DESC, CASE WHEN rank <= 20 THEN length(left(text, 4000)) % 997 / 997 END DESC, rank) <= 20""")


# ---------------------------------------------------------------- every method by one SQL text: a probe is a question or one of its sub-queries

V.SQL["plain_asked"] = "SELECT item_id AS n, text AS query, NULL AS part FROM benchmark"
V.SQL["graph_asked"] = "SELECT item_id AS n, text || '. Which tools does the ' || coalesce(p_name, '') || ' need' AS query FROM benchmark LEFT JOIN part ON p_partkey = item_id"
V.SQL["mparents"] = V.SQL["gparents"].replace("lpad(p_partkey::VARCHAR, 8, '0')", "'c' || p_partkey").replace("SELECT ", """SELECT 'd' || p_partkey // 2 AS parent_doc_id,
  '(' || p_name || ') requires ' || p_type || ' ' || p_brand || ' before use. Note: ' || p_type || ' ' || p_brand || ' REQUIRES size ' || p_size || '! Nothing else? A requirement, size ' || p_size || ' requires -tools-' AS text, """, 1)


def method_ctes(method, with_graph_words=True):
    """CTEs up to ``cands(n, kind, item_id, parent_doc_id, score, evidence, rank)`` and ``mdocs`` of a method."""
    _, use_vector, use_bm25, use_graph, boost, _, split = plan.method_row(method)
    kind = "CASE n % 3 WHEN 0 THEN 'multi_hop' WHEN 1 THEN 'semantic' ELSE 'lookup' END"
    facts = r"list_slice(list_filter(list_transform(string_split_regex(query, '\.\s'), lambda f: trim(f)), lambda f: f <> ''), 1, 4)"
    parts = f"CASE WHEN kind IN ('multi_hop', 'comparison') AND len(f) > 0 THEN f ELSE [query] END" if split else "[query]"  # noqa: F541
    ctes = [("masked", V.SQL["graph_asked" if with_graph_words else "plain_asked"]),
            ("probes", f"""SELECT n, kind, turn, query, n || chr(1) || 'sq' || turn AS query_id, (n % 10)::VARCHAR AS label, {V.source_sql('n')} AS hint FROM (
  SELECT n, kind, unnest(p) AS query, generate_subscripts(p, 1) AS turn FROM (SELECT n, kind, {parts} AS p FROM (SELECT n, query, {kind} AS kind, {facts} AS f FROM masked)))"""),
            ("questions", "SELECT query_id, query FROM probes")]
    ctes += [(name, SQL[name]) for name in ("items", "toks", "corpus", "posts", "qterms", "dfs", "scored", "docs", "attrs", "vecs", "cents", "sims", "rbm")]
    ctes.append(("rknn", """SELECT p.query_id, s.item_id, s.score, row_number() OVER (PARTITION BY p.query_id ORDER BY s.score DESC, s.item_id) AS rank
  FROM probes p JOIN sims s ON s.query_id = p.label QUALIFY rank <= 30"""))
    if use_vector and use_bm25:
        ctes.append(("fused", """SELECT f.*, parent_chunk_id, parent_doc_id, source_type FROM (
  SELECT query_id, item_id, min(v) AS v, min(b) AS b, round(coalesce(1 / (60 + min(v)), 0) + coalesce(1 / (60 + min(b)), 0), 9) AS score
  FROM (SELECT query_id, item_id, rank AS v, NULL AS b FROM rknn UNION ALL SELECT query_id, item_id, NULL, rank FROM rbm) GROUP BY ALL) f LEFT JOIN attrs USING (item_id)"""))
    else:
        ctes.append(("fused", f"SELECT r.*, parent_doc_id, source_type FROM {'rknn' if use_vector else 'rbm'} r LEFT JOIN attrs USING (item_id)"))
    rows = "SELECT query_id, item_id, parent_doc_id, source_type, score, [item_id] AS evidence FROM fused"
    if use_graph:
        ctes += [("gparents", SQL["mparents"]), ("gquestions", f"SELECT query_id, query, {'hint' if boost else 'NULL'} AS hint FROM probes")]
        ctes += [(name, SQL[name]) for name in ("phrases", "gents", "grels", "entities", "rels", "rel_chunks", "seeds", "d0", "near", "near_scores")]
        ctes.append(("met", """SELECT query_id, chunk_id AS item_id, parent_doc_id, source_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT c.query_id, chunk_id, parent_doc_id, source_type,
    round(score + CASE WHEN hint = source_type THEN 0.15 ELSE 0 END, 9) AS score FROM near_scores c JOIN gparents USING (chunk_id) JOIN gquestions USING (query_id))) WHERE rank <= 20"""))
        rows = """SELECT f.query_id, f.item_id, f.parent_doc_id, f.source_type, round(score + coalesce(1 / (60 + m.rank), 0), 9) AS score,
    CASE WHEN m.item_id IS NULL THEN [f.item_id] ELSE [f.item_id, m.item_id] END AS evidence FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY score DESC, least(coalesce(v, 999), coalesce(b, 999)), item_id) AS place FROM fused) f
    LEFT JOIN met m ON m.query_id = f.query_id AND m.item_id = f.parent_chunk_id AND place = 1
  UNION ALL SELECT query_id, item_id, parent_doc_id, source_type, round(1 / (60 + rank), 9), [item_id] FROM met m
    WHERE NOT EXISTS (FROM fused f WHERE f.query_id = m.query_id AND f.parent_chunk_id = m.item_id)"""
    value = "CASE WHEN source_type = hint THEN round(score * 1.15, 9) ELSE score END" if boost else "score"
    ctes += [("all_rows", rows), ("cands", f"""SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, item_id) AS rank FROM (
  SELECT n, kind, item_id, parent_doc_id, {value} AS score, evidence FROM all_rows r JOIN probes USING (query_id) QUALIFY row_number() OVER (PARTITION BY n, item_id ORDER BY {value} DESC, turn) = 1)"""),
             ("mdocs", "SELECT n, kind, parent_doc_id, arg_min(item_id, rank) AS item_id, row_number() OVER (PARTITION BY n ORDER BY min(rank)) AS rank FROM cands WHERE parent_doc_id IS NOT NULL GROUP BY n, kind, parent_doc_id")]
    return "WITH " + ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)


def method_sql(method, with_graph_words=True):
    rerank_mode, use_graph = plan.method_row(method)[5], plan.method_row(method)[3]
    due = {"none": "false", "all": "true", "complex": "kind <> 'lookup'"}[rerank_mode]
    texts = "SELECT * FROM items" + (" UNION ALL SELECT chunk_id, text FROM gparents" if use_graph else "")
    return method_ctes(method, with_graph_words) + f""",
mtexts AS ({texts}),
placed AS (SELECT n, d.item_id, parent_doc_id, row_number() OVER (PARTITION BY n ORDER BY rank <= 20 DESC, CASE WHEN {due} AND rank <= 20 THEN coalesce(length(left(text, 4000)), 0) % 997 / 997 ELSE 0 END DESC, rank) AS rank
  FROM mdocs d LEFT JOIN mtexts t ON t.item_id = d.item_id)
SELECT n::VARCHAR AS query_id, item_id, parent_doc_id, rank::INTEGER AS rank FROM placed WHERE rank <= 20"""


def graph_questions(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("query_id"), "p_name")
    query = F.concat("query", F.lit(". Which tools does the "), F.coalesce("p_name", F.lit("")), F.lit(" need"))
    return full_questions(spark, sf).join(part, "query_id", "left").withColumn("query", query).withColumn(
        "answer_facts", F.split("query", r"\.\s")).drop("p_name")


def graph_corpus(spark, sf):
    """The documents with a graph over parts, whose chunks are parents of documents by number."""
    number = F.col("parent_doc_id").substr(F.lit(2), F.lit(12)).cast("bigint")
    parents = graph_views.parents(spark, sf).withColumn("parent_chunk_id", F.when(F.trim("parent_chunk_id") != "", F.concat(F.lit("c"), number))).withColumn(
        "parent_doc_id", F.concat(F.lit("d"), F.floor(number / 2)))
    plain = corpus(spark, sf)
    return plan.Corpus(plain.children, plain.vectors, graph_views.graph.build_graph(parents), None)


def graph_method(spark, sf, method):
    with_graph = graph_corpus if plan.method_row(method)[3] else corpus
    return plan.retrieve(method, graph_questions(spark, sf), with_graph(spark, sf), models(spark, sf), 30)


def graph_method_query(name, method):
    @query(name, method_sql(method))
    def run(spark, sf):
        return graph_method(spark, sf, method).documents.filter("rank <= 20").select("query_id", "item_id", "parent_doc_id", "rank")


for entry_name, method_name in [
        ("d28_chroma_only", "chroma_only"), ("d28_bm25_only", "bm25_only"), ("d28_hybrid_bm25_rrf", "hybrid_bm25_rrf"),
        ("d28_reranker", "chroma_bm25_rrf_reranker"), ("d28_graph_rrf", "chroma_bm25_graph_rrf"), ("d28_graph_rrf_reranker", "chroma_bm25_graph_rrf_reranker"),
        ("d28_strategy_matrix", "strategy_matrix"), ("d28_strategy_matrix_graph", "strategy_matrix_graph"),
        ("d28_strategy_matrix_decompose_graph", "strategy_matrix_decompose_graph")]:
    graph_method_query(entry_name, method_name)


# a question needs the parent that its part names and the document of its number
@query("d28_evidence_coverage", method_ctes("chroma_bm25_graph_rrf") + """,
ids AS (SELECT n, rank, unnest(evidence) AS id FROM cands),
wanted AS (SELECT n, 'part' AS g, 'c' || n AS id FROM masked UNION ALL SELECT n, 'part', 'c' || (n + 1) FROM masked UNION ALL SELECT n, 'text', n::VARCHAR FROM masked),
reached AS (SELECT n, g, min(rank) AS rank FROM wanted LEFT JOIN ids USING (n, id) GROUP BY n, g)
SELECT n::VARCHAR AS question_id, 2::BIGINT AS n_groups, k::INTEGER AS k, count(*) FILTER (rank <= k) / 2 AS evidence_coverage FROM reached, (SELECT unnest([5, 10, 20]) AS k) GROUP BY n, k""")
def d28_evidence(spark, sf):
    asked = graph_questions(spark, sf).select(F.col("query_id").alias("question_id"))
    found = graph_method(spark, sf, "chroma_bm25_graph_rrf").coverage.withColumnRenamed("query_id", "question_id")
    number = F.col("question_id").cast("bigint")
    group = lambda name, ident: F.struct(F.lit(name).alias("group_id"), ident.alias("evidence_id"))
    groups = asked.select("question_id", F.inline(F.array(
        group("part", F.concat(F.lit("c"), number)), group("part", F.concat(F.lit("c"), number + 1)), group("text", F.col("question_id")))))
    return metrics.evidence_coverage_at_k(asked, found, groups, [5, 10, 20])


method_query("d28_retrieve_strategy_matrix_decompose", "strategy_matrix_decompose", method_sql("strategy_matrix_decompose", False))
HARD_CTES = V.ctes(*V.BM25[:-1], "docs", "attrs", "decided", "vecs", "cents", "sims") + f""",
rknn AS (SELECT d.query_id, item_id, row_number() OVER (PARTITION BY d.query_id ORDER BY s.score DESC, item_id) AS rank
  FROM decided d JOIN (SELECT query_id AS label, item_id, score FROM sims) s ON s.label = (d.query_id::BIGINT % 10)::VARCHAR JOIN attrs USING (item_id) WHERE {ADMITS} QUALIFY rank <= 30),
rbm AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored JOIN attrs USING (item_id) JOIN decided USING (query_id) WHERE {ADMITS} QUALIFY rank <= 30),
rfused AS ({V.SQL["rfused"]}), rdocs AS ({V.SQL["rdocs"].format(score="score")})"""
method_query("d28_retrieve_hard_filter", "chroma_bm25_rrf", HARD_CTES + LAST, with_rules=True)


# no title holds the keywords, so hard questions are broadened once
@query("e08_retrieve_with_fallback", V.ctes(*V.BM25[:-1]) + """
SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank, CASE WHEN query_id::BIGINT % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS attempt
FROM scored QUALIFY rank <= 5""")
def e08(spark, sf):
    asked = full_questions(spark, sf).withColumn("source_hints", F.col("source_types"))
    rules = decisions(spark, sf).withColumn("title_keywords", F.array(F.lit("no such title")))
    children = corpus(spark, sf)

    def search(questions, given):
        return plan.lexical_channel(questions, children, 5, given)

    return plan.retrieve_with_fallback(asked, rules, search).withColumn("score", F.round("score", 6))


# an order asks for its lines: a hard filter shows the first, a soft one those that were not returned, a rewritten query all of them.  Urgent orders
# need three sub-queries covered, users see lines of their own, public ones and those of a granted line status
def order_passes(spark, sf):
    key, orders = F.col("o_orderkey"), V.table(spark, sf, "orders")
    number = key.cast("string").alias("query_id")
    asked = orders.select(number, F.concat(F.when(key % 5 == 0, "industry trends of ").otherwise("state of "), F.col("o_custkey").cast("string")).alias("query"),
                          F.array(F.lit("erp")).alias("source_hints"))
    rules = orders.filter("o_orderstatus <> 'P'").select(number, F.when(F.col("o_orderstatus") == "F", "hard").otherwise("none").alias("mode"), F.lit("by status").alias("reason"))
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("query_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("item_id"),
        F.col("l_linenumber").cast("int").alias("rank"), "l_returnflag", F.array(F.concat(F.lit("sq"), F.col("l_linenumber") % 3)).alias("matched_sub_query_ids"),
        F.concat(F.lit("u"), F.col("l_suppkey") % 4).alias("owner_user_id"), F.col("l_linestatus").alias("knowledge_base_id"),
        F.when(F.col("l_quantity") > 40, "enterprise_public").otherwise("private").alias("visibility"))
    users = orders.select(number, F.concat(F.lit("u"), F.col("o_custkey") % 4).alias("user_id"))
    grants = V.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "u0").otherwise("u1").alias("user_id"), F.col("l_linestatus").alias("knowledge_base_id")).distinct()
    subs = orders.filter("o_orderpriority = '1-URGENT'").select(number, F.explode(F.array(F.lit("sq0"), F.lit("sq1"), F.lit("sq2"))).alias("sub_query_id"))

    def search(questions, given):
        met = lines.join(questions.select("query_id", "query"), "query_id").join(given.select("query_id", "mode"), "query_id", "left")
        hit = F.when(F.col("query").endswith("evidence"), True).when(F.col("mode") == "hard", F.col("rank") == 1).otherwise(F.col("l_returnflag") != "R")
        return met.filter(hit).select(*lines.columns)

    return plan.evidence_passes(asked, rules, search, 1, subs, (users, grants), orders.filter(key % 41 == 0).select(number))


V.SQL["line_rows"] = """
SELECT o_orderkey AS q, l_linenumber AS rank, k, CASE k WHEN 'h' THEN l_linenumber = 1 WHEN 's' THEN l_returnflag <> 'R' ELSE true END AS hit,
  l_suppkey % 4 = o_custkey % 4 OR l_quantity > 40 OR (l_linestatus = 'O' AND o_custkey % 4 = 0) OR (l_linestatus <> 'O' AND o_custkey % 4 = 1) AS sees
FROM orders JOIN lineitem ON l_orderkey = o_orderkey, (SELECT unnest(['h', 's', 'a']) AS k)"""
V.SQL["line_passes"] = """
SELECT *, guard OR emptied OR enough AS stops, CASE WHEN hard THEN strpos('hsa', k) ELSE strpos('sa', k) END AS attempt FROM (
  SELECT *, n = 0 AND n_before > 0 AS emptied, n > 0 AND (NOT urgent OR c = 3) AS enough FROM (
    SELECT o_orderkey AS q, kinds.k, o_orderstatus = 'F' AS hard, o_orderkey % 41 = 0 AS guard, o_orderkey % 5 = 0 AS public, o_orderpriority = '1-URGENT' AS urgent,
      count(*) FILTER (hit) AS n_before, count(*) FILTER (hit AND sees) AS n, count(DISTINCT rank % 3) FILTER (hit AND sees) AS c
    FROM orders CROSS JOIN (SELECT unnest(['h', 's', 'a']) AS k) kinds LEFT JOIN line_rows r ON r.q = o_orderkey AND r.k = kinds.k GROUP BY ALL))"""
V.SQL["line_ends"] = """
SELECT * FROM line_passes WHERE attempt > 0 AND (stops OR k = 'a') QUALIFY row_number() OVER (PARTITION BY q ORDER BY attempt) = 1"""


@query("e08_evidence_states", V.ctes("line_rows", "line_passes", "line_ends") + """
SELECT q::VARCHAR AS query_id, attempt::INTEGER AS attempt, (hard AND k <> 'h')::INTEGER AS fallback_count, (k = 'a')::INTEGER AS retry_count, n AS n_documents,
  CASE WHEN urgent THEN c / 3 WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS context_score, enough AS enough_evidence,
  CASE WHEN guard OR emptied THEN 'insufficient_evidence' WHEN enough AND NOT public THEN 'generate' ELSE 'external_search' END AS next_action FROM line_ends""")
def e08_states(spark, sf):
    return order_passes(spark, sf).states


@query("e08_evidence_rows", V.ctes("line_rows", "line_passes", "line_ends") + """
SELECT q::VARCHAR AS query_id, q || '-' || rank AS item_id, rank::INTEGER AS rank, attempt::INTEGER AS attempt FROM line_ends JOIN line_rows USING (q, k) WHERE hit AND sees""")
def e08_rows(spark, sf):
    return order_passes(spark, sf).selected.select("query_id", "item_id", "rank", "attempt")

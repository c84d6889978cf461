"""Scans, index rows and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog import text as T
from catalog import views as V
from lodestone.operators import metrics
from lodestone.session import shared_folder
from lodestone.sources import files, sinks, tables


@query("a01_scan_documents", "SELECT doc_id::VARCHAR AS doc_id, source AS source_type, lang AS title, md5(text) AS content FROM documents")
def a01(spark, sf):
    names = {"source_type": "source", "title": "lang", "content": "text"}
    return files.scan_documents(spark, f"{sf}/documents.parquet", names).withColumn("content", F.md5("content"))


def raw_questions(spark, sf):
    """benchmark as an unclean question file: scalars for lists, nulls inside lists, wide blanks."""
    gold = V.passage_gold(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    base = V.table(spark, sf, "benchmark").withColumn("question_id", F.col("item_id").cast("string")).join(gold, "question_id", "left")
    return base.select(
        "question_id", F.lit("semantic").alias("question_type"), V.source_of(F.col("item_id")).alias("source_types"),
        F.concat(F.lit("\r\n　"), "text", F.lit(" \t x")).alias("question"),
        F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array(F.lit(None).cast("string"))).alias("expected_doc_ids"))


V.SQL["clean_questions"] = f"""
SELECT item_id::VARCHAR AS question_id, {V.source_sql('item_id')} AS source_types,
  {T.sql_clean("chr(13) || chr(10) || '　' || text || ' ' || chr(9) || ' x'")} AS question FROM benchmark"""


@query("a02_scan_questions", V.ctes("clean_questions", "passage_keys", "passage_gold") + """
SELECT question_id, source_types, question, '' AS gold_answer, coalesce(ids, '') AS expected_doc_ids FROM clean_questions
LEFT JOIN (SELECT question_id, string_agg(item_id, '|' ORDER BY item_id) AS ids FROM passage_gold GROUP BY ALL) USING (question_id)""")
def a02(spark, sf):
    questions = files.normalize_questions(raw_questions(spark, sf))
    return questions.select("question_id", F.array_join("source_types", "|").alias("source_types"), "question", "gold_answer",
                            F.array_join("expected_doc_ids", "|").alias("expected_doc_ids"))


@query("a02_expected_ids", V.ctes("passage_keys", "passage_gold") + " SELECT DISTINCT item_id AS doc_id FROM passage_gold")
def a02_ids(spark, sf):
    return files.expected_ids(files.normalize_questions(raw_questions(spark, sf)))


# documents as uploaded files; the digests of labelled ones are registered
@query("a06_ingest_new_files", """
SELECT md5, path, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'loaded' END AS status FROM (
  SELECT md5(text) AS md5, min(lpad(doc_id::VARCHAR, 12, '0')) AS path, any_value(text) AS text FROM (
    SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN '  ' ELSE text END AS text FROM documents) GROUP BY 1)
WHERE md5 NOT IN (SELECT md5(text) FROM documents SEMI JOIN labels USING (doc_id))""")
def a06(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    uploaded = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 7, "  ").otherwise(F.col("text"))).select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").cast("binary").alias("content"), "text")
    registry = docs.join(V.table(spark, sf, "labels"), "doc_id", "left_semi").select(F.md5(F.col("text").cast("binary")).alias("md5"))
    return files.ingest_new_files(uploaded, registry).drop("text")


# order lines as child chunks of order chunks, with gaps that the parent fills
V.SQL["line_children"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chunk_id, l_orderkey::VARCHAR AS parent_chunk_id,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 'd' || l_orderkey END AS parent_doc_id, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS source_type,
  '' AS doc_semantic_type, NULL::VARCHAR AS title, '' AS section_heading, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'line ' || l_partkey END AS text,
  l_linenumber AS child_chunk_index FROM lineitem"""
V.SQL["order_parents"] = """
SELECT o_orderkey::VARCHAR AS parent_chunk_id, 'p' || o_orderkey AS parent_doc_id, o_orderstatus AS source_type, lower(o_orderpriority) AS doc_semantic_type,
  'order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS section_heading, 'text ' || o_custkey AS text
FROM orders WHERE o_orderpriority <> '5-LOW'"""


def line_children(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"),
        F.col("l_orderkey").cast("string").alias("parent_chunk_id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("d"), "l_orderkey")).alias("parent_doc_id"),
        F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("source_type"), F.lit("").alias("doc_semantic_type"),
        F.lit(None).cast("string").alias("title"), F.lit("").alias("section_heading"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("line "), "l_partkey")).alias("text"),
        F.col("l_linenumber").alias("child_chunk_index"))


def order_parents(spark, sf):
    return V.table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").cast("string").alias("parent_chunk_id"), F.concat(F.lit("p"), "o_orderkey").alias("parent_doc_id"),
        F.col("o_orderstatus").alias("source_type"), F.lower("o_orderpriority").alias("doc_semantic_type"),
        F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("section_heading"),
        F.concat(F.lit("text "), "o_custkey").alias("text"))


@query("a11_build_index_rows", V.ctes("line_children", "order_parents") + """
SELECT chunk_id, c.parent_chunk_id, coalesce(nullif(c.parent_doc_id, ''), nullif(p.parent_doc_id, ''), '') AS parent_doc_id,
  coalesce(nullif(c.source_type, ''), nullif(p.source_type, ''), '') AS source_type,
  coalesce(nullif(c.title, ''), nullif(p.title, ''), '') AS title, coalesce(nullif(c.section_heading, ''), nullif(p.section_heading, ''), '') AS section_heading,
  coalesce(nullif(c.doc_semantic_type, ''), nullif(p.doc_semantic_type, ''), 'generic_doc') AS doc_semantic_type,
  coalesce(c.text, '') AS child_text, coalesce(p.text, c.text, '') AS parent_text, 0 AS chunk_index, 0 AS parent_chunk_index, child_chunk_index
FROM line_children c LEFT JOIN order_parents p ON p.parent_chunk_id = c.parent_chunk_id""")
def a11(spark, sf):
    return tables.build_index_rows(line_children(spark, sf), order_parents(spark, sf))


@query("a12_upsert_rows", """
SELECT o_custkey, coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM
  (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) o
  FULL JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) n
  USING (o_custkey)""")
def a12(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    old = orders.filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    return tables.upsert_rows(old, orders.filter("o_orderstatus = 'F'").drop("o_orderstatus"), "o_custkey", "o_orderkey")


@query("a13_contiguous_part", """
SELECT doc_id, pos AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, ceil(count(*) OVER () / 7)::BIGINT AS size FROM documents)
WHERE pos >= 2 * size AND pos < 3 * size""")
def a13(spark, sf):
    return tables.contiguous_part(V.table(spark, sf, "documents").select("doc_id"), 7, 3, "doc_id")


@query("a14_delete_where", """
SELECT page_id, owner FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'u' || page_id % 5 END AS owner FROM pages) WHERE owner IS DISTINCT FROM 'u2'""")
def a14(spark, sf):
    owned = V.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 6 != 0, F.concat(F.lit("u"), F.col("page_id") % 5)).alias("owner"))
    return tables.delete_where(owned, F.col("owner") == "u2")


V.SQL["line_parents"] = """
SELECT l_orderkey || ':' || l_linenumber AS parent_chunk_id, CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE l_orderkey::VARCHAR END AS parent_doc_id,
  l_linenumber AS parent_chunk_index, max(CASE l_returnflag WHEN 'A' THEN '' ELSE l_returnflag END) AS doc_semantic_type, max(l_partkey)::VARCHAR AS text
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def line_parents(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag"))).alias("doc_semantic_type"),
        F.max("l_partkey").cast("string").alias("text")).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("parent_chunk_id"),
        F.when(F.col("l_orderkey") % 9 == 0, "").otherwise(F.col("l_orderkey").cast("string")).alias("parent_doc_id"),
        F.col("l_linenumber").alias("parent_chunk_index"), "doc_semantic_type", "text")


@query("a15_doc_type_lookup", V.ctes("line_parents") + """
SELECT parent_doc_id, coalesce(nullif(arg_max(doc_semantic_type, parent_chunk_index), ''), 'generic_doc') AS doc_semantic_type
FROM line_parents WHERE parent_doc_id <> '' GROUP BY ALL""")
def a15(spark, sf):
    return files.doc_type_lookup(line_parents(spark, sf))


@query("a15_scan_parent_texts", V.ctes("line_parents") + " SELECT parent_chunk_id, text FROM line_parents")
def a15_texts(spark, sf):
    return files.scan_parent_texts(line_parents(spark, sf))


# ---------------------------------------------------------------- written and read again

#: Lines in a text file that is written to be read back whole.
FILE_LINES = 500


def folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("a03_scan_jsonl", "SELECT page_id, url, md5(html) AS html FROM pages")
def a03(spark, sf):
    path = folder(spark)
    sinks.write_jsonl(V.table(spark, sf, "pages"), path)
    return files.scan_jsonl(spark, path, "page_id bigint, url string, html string").withColumn("html", F.md5("html"))


@query("a04_load_questions_jsonl", r"""
SELECT conv_id || '-' || turn AS question_id, '' AS question_type, 0::BIGINT AS n_sources, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'x' || conv_id || '/y|z' END AS groups FROM conversations""")
def a04(spark, sf):
    path = folder(spark)
    c = F.col("conv_id")
    groups = F.when(c % 3 == 0, F.lit('[[], [" "], "none", null]')).otherwise(F.concat(F.lit('[[" x'), c, F.lit('", null, "y "], [""], ["z"], 7]')))
    lines = V.table(spark, sf, "conversations").select(F.concat(
        F.lit('{"question_id": "'), c, F.lit("-"), F.col("turn"), F.lit('", "question": "q", "source_types": null, "required_evidence_groups": '), groups, F.lit("}")).alias("value"))
    lines.write.text(path)
    loaded = files.load_questions_jsonl(spark, path)
    shown = F.array_join(F.transform("required_evidence_groups", lambda g: F.array_join(g, "/")), "|")
    return loaded.select("question_id", "question_type", F.size("source_types").cast("bigint").alias("n_sources"), shown.alias("groups"))


@query("a05_scan_text_files", "SELECT count(*) AS n, sum(length(text)) ::BIGINT AS chars FROM (SELECT replace(text, chr(10), ' ') AS text FROM documents)")
def a05(spark, sf):
    """documents as text files of one line each per row, read back as whole files.

    A file is a row of the scan, so it has a bounded number of lines however large the table's own files are.
    """
    path = folder(spark)
    lines = V.table(spark, sf, "documents").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_LINES).text(path)
    texts = files.scan_text_files(spark, path).select(F.explode(F.split(F.trim("text", F.lit("\n")), "\n")).alias("line"))
    return texts.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("a08_write_details_csv", V.ctes(*V.METRICS) + """
SELECT question_id, max(hit) FILTER (k = 5) AS hit_5, round(max(recall) FILTER (k = 5), 6) AS recall_5, round(max(rr) FILTER (k = 5), 6) AS rr_5, coalesce(max(top), '') AS top FROM metrics
LEFT JOIN (SELECT question_id, string_agg(item_id, '|' ORDER BY rank) AS top FROM ranking WHERE rank <= 5 GROUP BY ALL) USING (question_id) GROUP BY question_id""")
def a08(spark, sf):
    path = folder(spark)
    at5 = metrics.question_metrics(V.asked(spark, sf), V.ranking(spark, sf), V.returned(spark, sf), [5])
    top = V.ranking(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("hits"))
    no_ids = F.array().cast("array<string>")
    details = V.asked(spark, sf).join(at5, "question_id").join(top, "question_id", "left").select(
        F.lit("m").alias("method"), F.lit("m").alias("normalized_method"), "question_id", "question_type", "source_types", no_ids.alias("expected_doc_ids"),
        F.coalesce(F.transform("hits", lambda h: h["item_id"]), no_ids).alias("retrieved_parent_doc_ids"), "latency_ms", F.size("hits").alias("dedup_parent_results"),
        F.lit(0).alias("required_evidence_groups_count"), F.lit(0.0).alias("evidence_coverage"), F.lit(False).alias("reranker_used"), F.lit(False).alias("source_boost_applied"),
        *[F.col(m).alias(f"{m}@5") for m in ("hit", "precision", "recall", "f1", "ndcg", "ap", "rr")], F.lit(0.0).alias("evidence_coverage@5"), no_ids.alias("matched_doc_ids@5"))
    sinks.write_details_csv(details, path, [5])
    back = spark.read.option("header", "true").csv(path)
    return back.select("question_id", F.col("`hit@5`").cast("int").alias("hit_5"), F.round(F.col("`recall@5`").cast("double"), 6).alias("recall_5"),
                       F.round(F.col("`rr@5`").cast("double"), 6).alias("rr_5"), F.coalesce("top_parent_doc_ids", F.lit("")).alias("top"))


@query("a09_write_run_artifacts", """
SELECT kind, 'run-1' AS run_id, count(*) AS n FROM (SELECT 'config' AS kind FROM region UNION ALL SELECT 'summary' FROM nation UNION ALL SELECT 'details' FROM customer UNION ALL SELECT 'failures' FROM supplier) GROUP BY ALL""")
def a09(spark, sf):
    path = folder(spark)
    parts = [V.table(spark, sf, n) for n in ("region", "nation", "customer", "supplier")]
    sinks.write_run_artifacts(path, "run-1", *parts)
    counts = [spark.read.json(f"{path}/{kind}").groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "run_id", "n")
              for kind in ("config", "summary", "details", "failures")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])

"""Inputs of the registered queries, derived from the given tables: a Spark form and its SQL twin.

Each SQL twin is the body of a CTE; ``ctes`` strings several together in the order they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import model
from lodestone.session import SCAN_PARTITIONS

SOURCE_LIST = ", ".join(f"'{s}'" for s in model.ALLOWED_SOURCES)
KS = [1, 5, 10, 20]
SQL: dict[str, str] = {}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in names)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table.  A session may ask for long texts to be dealt out anew: local files often are one row group."""
    scan, parts = spark.read.parquet(f"{sf}/{name}.parquet"), spark.conf.get(SCAN_PARTITIONS, None)
    return scan.repartition(int(parts)) if parts and name in ("documents", "pages") else scan


def source_of(number) -> F.Column:
    names = F.array(*[F.lit(s) for s in model.ALLOWED_SOURCES])
    return F.get(names, F.pmod(number, F.lit(len(model.ALLOWED_SOURCES))).cast("int"))


def source_sql(number: str) -> str:
    return f"list_extract([{SOURCE_LIST}], ({number} % 9 + 1)::INTEGER)"


# ---------------------------------------------------------------- documents and questions

def docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as the retrieval model sees them: title = first five words, source by id."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        source_of(F.col("doc_id")).alias("source_type"),
        F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,4})", 1).alias("title"),
        F.col("text").alias("content"),
    )


SQL["docs"] = rf"""
SELECT doc_id::VARCHAR AS doc_id, {source_sql('doc_id')} AS source_type,
       regexp_extract(text, '^\s*(\S+(?:\s+\S+){{0,4}})', 1) AS title, text AS content
FROM documents"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


SQL["questions"] = "SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")


SQL["items"] = "SELECT doc_id::VARCHAR AS item_id, text FROM documents"


def passage_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold the first eight words of a passage, as a hash join on eight-word runs."""
    def words(text):
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    keys = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"),
        F.array_join(F.slice(words(F.col("text")), 1, 8), " ").alias("run"))
    runs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(
        F.size("w") >= 8).select("item_id", F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.size("w") - 7),
            lambda i: F.array_join(F.slice(F.col("w"), i, 8), " "))).alias("run"))
    return runs.join(keys, "run").select("question_id", "item_id").distinct()


SQL["passage_keys"] = r"""
SELECT item_id::VARCHAR AS question_id, ' ' || array_to_string(list_slice(
  list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), 1, 8), ' ') || ' ' AS run
FROM benchmark"""
SQL["passage_gold"] = r"""
SELECT DISTINCT question_id, item_id FROM passage_keys JOIN (
  SELECT doc_id::VARCHAR AS item_id, ' ' || array_to_string(list_filter(
    regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), ' ') || ' ' AS flat FROM documents)
ON contains(flat, run)"""


def bm25_sql(items: str, queries: str, pattern: str, k: int | None, drop_empty: bool = False) -> dict[str, str]:
    """CTEs of a BM25 search: toks, corpus, posts, qterms, dfs, scored and, with k, bm25."""
    out = {
        "toks": f"SELECT item_id, {pattern.format(text='text')} AS toks FROM {items}",
        "corpus": "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM toks"
                  + (" WHERE len(toks) > 0" if drop_empty else ""),
        "posts": "SELECT item_id, dl, term, count(*) AS tf FROM (SELECT item_id, len(toks) AS dl, "
                 "unnest(toks) AS term FROM toks) GROUP BY ALL",
        "qterms": f"SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, "
                  f"unnest({pattern.format(text='query')}) AS term FROM {queries}) GROUP BY ALL",
        "dfs": "SELECT term, count(*) AS df FROM posts GROUP BY term",
        "scored": "SELECT query_id, item_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 "
                  "/ (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score "
                  "FROM qterms JOIN posts USING (term) JOIN dfs USING (term), corpus GROUP BY ALL",
    }
    if k is not None:
        out["bm25"] = ("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank "
                       f"FROM scored QUALIFY rank <= {k}")
    return out


CHILD_SQL = r"regexp_extract_all(lower({text}), '[a-z0-9_.$%/-]+')"
PARENT_SQL = (r"list_concat(regexp_extract_all(lower({text}), '[a-z0-9_./#-]+'), "
              r"regexp_extract_all(lower({text}), '[一-鿿]'))")
SQL.update(bm25_sql("items", "questions", CHILD_SQL, 20))
BM25 = ["items", "questions", "toks", "corpus", "posts", "qterms", "dfs", "scored", "bm25"]


# ---------------------------------------------------------------- large rankings from the order tables

def purchases(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_discount")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("question_id"),
        F.col("l_partkey").cast("string").alias("item_id"), "l_extendedprice", "l_orderkey",
        "l_returnflag", "l_discount", "o_orderpriority")


SQL["purchases"] = """
SELECT o_custkey::VARCHAR AS question_id, l_partkey::VARCHAR AS item_id, l_extendedprice, l_orderkey,
       l_returnflag, l_discount, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """One question per customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("question_id"),
        F.lower("c_mktsegment").alias("question_type"),
        F.array(source_of(F.col("c_nationkey")), source_of(F.col("c_nationkey") + 4)).alias("source_types"),
        F.abs("c_acctbal").alias("latency_ms"))


SQL["asked"] = f"""
SELECT c_custkey::VARCHAR AS question_id, lower(c_mktsegment) AS question_type,
       [{source_sql('c_nationkey')}, {source_sql('(c_nationkey + 4)')}] AS source_types,
       abs(c_acctbal) AS latency_ms
FROM customer"""


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer, the parts bought, dearest first; a part bought twice is listed twice."""
    order = Window.partitionBy("question_id").orderBy(
        F.col("l_extendedprice").desc(), "l_orderkey", "item_id")
    return purchases(spark, sf).withColumn("rank", F.row_number().over(order)).select(
        "question_id", "item_id", "rank")


SQL["ranking"] = """
SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id
  ORDER BY l_extendedprice DESC, l_orderkey, item_id) AS rank FROM purchases"""


def returned(spark: SparkSession, sf: str) -> DataFrame:
    """Gold: parts returned although well discounted."""
    return purchases(spark, sf).filter("l_returnflag = 'R' AND l_discount >= 0.07").select(
        "question_id", "item_id").distinct()


SQL["returned"] = """
SELECT DISTINCT question_id, item_id FROM purchases WHERE l_returnflag = 'R' AND l_discount >= 0.07"""


def evidence_groups(spark: SparkSession, sf: str) -> DataFrame:
    return purchases(spark, sf).filter("l_returnflag = 'R' AND l_discount >= 0.07").select(
        "question_id", F.col("o_orderpriority").alias("group_id"), F.col("item_id").alias("evidence_id")).distinct()


SQL["evidence_groups"] = """
SELECT DISTINCT question_id, o_orderpriority AS group_id, item_id AS evidence_id FROM purchases
WHERE l_returnflag = 'R' AND l_discount >= 0.07"""

SQL["hits"] = """
SELECT question_id, item_id, min(rank) AS rank FROM ranking JOIN returned USING (question_id, item_id)
WHERE rank <= 20 GROUP BY ALL"""
SQL["numbered"] = "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS hit_no FROM hits"
SQL["expected"] = "SELECT question_id, count(*) AS n_expected FROM returned GROUP BY ALL"
SQL["counted"] = f"""
SELECT q.question_id, k, coalesce(any_value(n_expected), 0) AS n_expected,
  count(rank) FILTER (rank <= k) AS n_hits, min(rank) AS first_rank,
  coalesce(sum(hit_no / rank) FILTER (rank <= k), 0) AS ap_sum,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg
FROM asked q CROSS JOIN (SELECT unnest({KS}) AS k)
LEFT JOIN expected USING (question_id) LEFT JOIN numbered USING (question_id) GROUP BY q.question_id, k"""
SQL["metrics"] = """
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
FROM (SELECT question_id, k, n_expected, n_hits, (n_hits > 0)::INTEGER AS hit, n_hits / k AS precision,
  CASE WHEN n_expected > 0 THEN n_hits / n_expected ELSE 0 END AS recall,
  CASE WHEN first_rank <= k THEN 1 / first_rank ELSE 0 END AS rr,
  round(CASE WHEN n_expected > 0 THEN ap_sum / least(n_expected, k) ELSE 0 END, 12) AS ap,
  round(CASE WHEN n_expected > 0 THEN dcg / list_sum(list_transform(range(1, least(n_expected, k) + 1),
    lambda r: 1 / log2(r + 1))) ELSE 0 END, 12) AS ndcg FROM counted)"""
METRICS = ["purchases", "asked", "ranking", "returned", "hits", "numbered", "expected", "counted", "metrics"]

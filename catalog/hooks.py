"""Model hooks, driven by small deterministic functions in place of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import retrieval as R
from catalog import views as V
from lodestone.operators import hooks, rerank



@query("u01_score_pairs", V.ctes(*V.BM25) + """
SELECT query_id, item_id, round(length(left(text, 4000)) % 997 / 997 - length(query) / 10000, 6) AS score FROM bm25 JOIN items USING (item_id) JOIN questions USING (query_id)""")
def u01(spark, sf):
    pairs = rerank.rerank_pairs(R.bm25_ranked(spark, sf), V.items(spark, sf), V.questions(spark, sf), 20, 4000)

    def factory():
        return lambda queries, texts: [len(t) % 997 / 997 - len(q) / 10000 for q, t in zip(queries, texts)]

    return hooks.score_pairs(pairs, factory).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("u02_embed", "SELECT doc_id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM documents")
def u02(spark, sf):
    def factory():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    rows = hooks.embed(V.table(spark, sf, "documents").select("doc_id", "text"), factory)
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("u03_judge", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE (length(html) / 100000)::VARCHAR END IS NOT NULL AS judged, CASE WHEN page_id % 5 = 0 THEN 'no url' END AS failure FROM pages""")
def u03(spark, sf):
    samples = V.table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("question"), F.array("html").alias("retrieved_contexts"),
        F.col("html").alias("answer"), F.lit("").alias("reference"))

    def factory():
        def evaluate(questions, contexts, answers, references):
            if not all(questions):
                raise ValueError("no url")
            return [{"faithfulness": str(len(a) / 100000)} for a in answers]

        return evaluate

    judged = hooks.judge(samples, factory, batch=1)
    return judged.select("page_id", F.col("scores").isNotNull().alias("judged"), F.col("judge_failure").alias("failure"))

"""Conversation and memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import retrieval as R
from catalog import views as V
from lodestone.functions import memory as M
from lodestone.operators import memories, sessions

NOW = "2024-02-01 00:00:00"
RECENT, TRIGGER = 1, 2  # no conversation of the table is longer than eight messages


def messages(spark, sf):
    return V.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


def stored(spark, sf):
    return V.table(spark, sf, "conversations").filter("turn = 0").select(
        F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" old "), "conv_id")).alias("summary"),
        (F.col("conv_id") % 3).cast("int").alias("summarized_turn_count"))


V.SQL["turns"] = """
SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no, text AS user_text, answer AS assistant_text FROM (
  SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'"""
V.SQL["sized"] = f"""
SELECT t.*, count(*) OVER (PARTITION BY session_id) AS total, session_id::INTEGER % 3 AS done FROM turns t"""


@query("h01_pair_turns", V.ctes("turns") + " SELECT * FROM turns")
def h01(spark, sf):
    return sessions.pair_turns(messages(spark, sf))


@query("h02_memory_context", V.ctes("turns", "sized") + f"""
SELECT session_id, turn_no, total AS total_turns, CASE WHEN total > {TRIGGER} THEN greatest(done, total - {RECENT}) ELSE done END AS compressed_turns FROM sized WHERE total <= {TRIGGER} OR turn_no >= total - {RECENT}""")
def h02(spark, sf):
    return sessions.memory_context(sessions.pair_turns(messages(spark, sf)), stored(spark, sf), RECENT, TRIGGER).select(
        "session_id", "turn_no", "total_turns", "compressed_turns")


DUE = f"total > {TRIGGER} AND turn_no >= done AND turn_no < total - {RECENT}"


@query("h03_summary_slice", V.ctes("turns", "sized") + f" SELECT session_id, turn_no, user_text, assistant_text, total - {RECENT} AS summarized_turn_count FROM sized WHERE {DUE}")
def h03(spark, sf):
    return sessions.summary_slice(sessions.pair_turns(messages(spark, sf)), stored(spark, sf), RECENT, TRIGGER)


@query("h04_fallback_summary", V.ctes("turns", "sized") + f"""
SELECT session_id, trim(CASE WHEN session_id::INTEGER % 2 = 0 THEN 'old ' || session_id || chr(10) ELSE '' END || '新增历史摘要：' || chr(10) ||
  string_agg('- 用户询问：' || left(user_text, 120) || '；助手回答：' || left(assistant_text, 160), chr(10) ORDER BY turn_no)) AS summary, max(total) - {RECENT} AS summarized_turn_count FROM sized WHERE {DUE} GROUP BY session_id""")
def h04(spark, sf):
    slices = sessions.summary_slice(sessions.pair_turns(messages(spark, sf)), stored(spark, sf), RECENT, TRIGGER)
    return sessions.fallback_summary(slices, stored(spark, sf))


def chat_sessions(spark, sf):
    c = F.col("conv_id")
    title = F.when(c % 4 == 0, F.concat(F.lit("Topic "), c)).when(c % 7 == 1, F.lit(None)).otherwise("新的对话")
    at = F.lit("2024-01-01").cast("timestamp")
    day = F.make_interval(days=(c % 31).cast("int"))
    return V.table(spark, sf, "conversations").filter("turn = 0").select(
        c.cast("string").alias("session_id"), (c % 10).cast("string").alias("user_id"), title.alias("title"), at.alias("created_at"),
        F.when(c % 5 != 0, at + day).alias("updated_at"))


V.SQL["chats"] = """
SELECT conv_id::VARCHAR AS session_id, (conv_id % 10)::VARCHAR AS user_id, CASE WHEN conv_id % 4 = 0 THEN 'Topic ' || conv_id WHEN conv_id % 7 = 1 THEN NULL ELSE '新的对话' END AS title,
  CASE WHEN conv_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((conv_id % 31)::INTEGER) ELSE TIMESTAMP '2024-01-01' END AS ts FROM conversations WHERE turn = 0"""


@query("h05_session_titles", V.ctes("chats") + """
SELECT session_id, CASE WHEN title = '新的对话' AND f IS NOT NULL THEN trim(left(f, 30), ' ' || chr(10)) || CASE WHEN length(f) > 30 THEN '...' ELSE '' END ELSE title END AS title
FROM chats LEFT JOIN (SELECT conv_id::VARCHAR AS session_id, arg_min(text, turn) AS f FROM conversations WHERE role = 'user' GROUP BY ALL) USING (session_id)""")
def h05(spark, sf):
    return sessions.session_titles(chat_sessions(spark, sf), messages(spark, sf)).select("session_id", "title")


@query("h06_user_sessions", V.ctes("chats") + " SELECT session_id, title FROM chats WHERE user_id = '3'")
def h06(spark, sf):
    return sessions.user_sessions(chat_sessions(spark, sf), "3").select("session_id", "title")


def clear_requests(spark, sf):
    """Every document asks to clear one session; some sessions do not exist, some belong to others."""
    d = F.col("doc_id")
    return V.table(spark, sf, "documents").select((d * 3).cast("string").alias("session_id"), (d % 10).cast("string").alias("user_id"))


@query("h06_session_ownership", V.ctes("chats") + """
SELECT r.session_id, r.user_id, CASE WHEN c.user_id IS NULL THEN 'new' WHEN c.user_id = r.user_id THEN 'own' ELSE 'foreign' END AS state
FROM (SELECT (doc_id * 3)::VARCHAR AS session_id, (doc_id % 10)::VARCHAR AS user_id FROM documents) r LEFT JOIN chats c USING (session_id)""")
def h06_state(spark, sf):
    return sessions.session_ownership(clear_requests(spark, sf), chat_sessions(spark, sf))


@query("h07_clear_sessions", V.ctes("chats") + """,
own AS (SELECT DISTINCT session_id FROM chats JOIN (SELECT (doc_id * 3)::VARCHAR AS session_id, (doc_id % 10)::VARCHAR AS user_id FROM documents) USING (session_id, user_id))
SELECT 'session' AS kind, count(*) AS n FROM chats WHERE session_id NOT IN (SELECT session_id FROM own)
UNION ALL SELECT 'message', count(*) FROM conversations WHERE conv_id::VARCHAR NOT IN (SELECT session_id FROM own)
UNION ALL SELECT 'memory', count(*) FROM chats WHERE session_id NOT IN (SELECT session_id FROM own)""")
def h07(spark, sf):
    kept = sessions.clear_sessions(chat_sessions(spark, sf), messages(spark, sf), stored(spark, sf), clear_requests(spark, sf))
    counts = [t.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, t in zip(("session", "message", "memory"), kept)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# every message is a candidate in two spellings; first messages of even conversations are stored, some deleted
V.SQL["cands"] = """
SELECT (conv_id % 10)::VARCHAR AS user_id, conv_id * 100 + turn * 2 + v AS ordinal, CASE WHEN v = 0 THEN '  ' || text ELSE lower(text) || ' ' END AS memory,
  sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM conversations, (SELECT unnest([0, 1]) AS v)"""
V.SQL["held"] = """
SELECT (conv_id % 10)::VARCHAR AS user_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM conversations WHERE turn = 0 AND conv_id % 2 = 0 AND conv_id % 6 <> 0"""


def candidates(spark, sf):
    both = V.table(spark, sf, "conversations").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("v") == 0, F.concat(F.lit("  "), "text")).otherwise(F.concat(F.lower("text"), F.lit(" ")))
    return both.select((F.col("conv_id") % 10).cast("string").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn") * 2 + F.col("v")).alias("ordinal"), text.alias("memory"))


def held(spark, sf):
    """Every message is a stored memory; those of half the first turns are active."""
    alive = (F.col("turn") == 0) & (F.col("conv_id") % 2 == 0) & (F.col("conv_id") % 6 != 0)
    return V.table(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).cast("string").alias("user_id"), M.memory_hash(F.col("text")).alias("hash"), F.when(alive, "active").otherwise("deleted").alias("status"))


@query("h08_dedup_memories", V.ctes("cands", "held") + """
SELECT user_id, hash, min(ordinal) AS ordinal FROM cands WHERE trim(memory) <> '' AND (user_id, hash) NOT IN (SELECT (user_id, hash) FROM held) GROUP BY ALL""")
def h08(spark, sf):
    return memories.dedup_memories(candidates(spark, sf), held(spark, sf)).select("user_id", "hash", "ordinal")


def memory_store(spark, sf):
    """Every vector is a memory of the user its label names; every eleventh is deleted."""
    v = F.col("vec_id")
    return V.table(spark, sf, "embeddings").select(
        v.cast("string").alias("id"), F.col("label").cast("string").alias("user_id"), F.concat(F.lit("mem "), v, F.lit(" topic-"), v % 7).alias("memory"), "embedding",
        F.when(v % 11 == 0, "deleted").otherwise("active").alias("status"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(v % 97).cast("int"))).alias("created_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"))


V.SQL["mstore"] = """
SELECT vec_id::VARCHAR AS id, vec_id, label::VARCHAR AS user_id, 'mem ' || vec_id || ' topic-' || vec_id % 7 AS memory, embedding::DOUBLE[] AS e, vec_id % 11 <> 0 AS active,
  TIMESTAMP '2024-01-01' + to_hours((vec_id % 97)::INTEGER) AS created_at FROM embeddings"""


# users' rows in order, each with its earlier neighbours: a row joins the list unless the list holds one of them
GREEDY = """,
open AS (SELECT * FROM mstore c WHERE {open}),
links AS (SELECT c.vec_id, list(o.vec_id) AS earlier FROM open c JOIN open o ON o.user_id = c.user_id AND o.vec_id < c.vec_id AND round(list_cosine_similarity(o.e, c.e), 9) >= {least} GROUP BY c.vec_id),
lists AS (SELECT user_id, list(list_concat([vec_id], coalesce(earlier, [])) ORDER BY vec_id) AS steps FROM open LEFT JOIN links USING (vec_id) GROUP BY user_id)
SELECT unnest(list_reduce(steps, lambda kept, row: CASE WHEN list_has_any(kept, row[2:]) THEN kept ELSE list_append(kept, row[1]) END))::VARCHAR AS id, user_id FROM lists"""


@query("h09_drop_semantic_duplicates", V.ctes("mstore", "vecs", "cents") + GREEDY.format(
    open="NOT EXISTS (SELECT 1 FROM cents WHERE query_id = c.user_id AND round(list_cosine_similarity(q, c.e), 9) >= 0.32)", least=0.32))
def h09(spark, sf):
    rows = memory_store(spark, sf).withColumn("ordinal", F.col("id").cast("bigint"))
    store = R.centroids(spark, sf).select(F.concat(F.lit("mean-"), "query_id").alias("id"), F.col("query_id").alias("user_id"), "embedding", F.lit("active").alias("status"))
    return memories.drop_semantic_duplicates(rows, store, 0.32).select("id", "user_id")


@query("h10_append_memories", V.ctes("cands", "held") + """
SELECT ordinal::VARCHAR AS id, user_id, CASE WHEN ordinal % 3 = 0 THEN 'task' ELSE 'other' END AS memory_type, CASE WHEN ordinal % 4 = 0 THEN 0 ELSE least(ordinal % 150 / 100, 1) END AS score, 'active' AS status
FROM (SELECT user_id, hash, min(ordinal) AS ordinal FROM cands WHERE trim(memory) <> '' AND (user_id, hash) NOT IN (SELECT (user_id, hash) FROM held) GROUP BY ALL)""")
def h10(spark, sf):
    o = F.col("ordinal")
    accepted = memories.dedup_memories(candidates(spark, sf), held(spark, sf)).select(
        o.cast("string").alias("id"), "user_id", F.lit("s").alias("session_id"), "memory", F.when(o % 3 == 0, " task").otherwise("guess").alias("memory_type"), "hash",
        F.when(o % 4 == 0, "none").otherwise((o % 150 / 100).cast("string")).alias("confidence"))
    return memories.append_memories(accepted, NOW).select("id", "user_id", "memory_type", "score", "status")


def memory_queries(spark, sf):
    q = F.col("query_id").cast("int")
    return R.centroids(spark, sf).select("query_id", F.col("query_id").alias("user_id"), "embedding", F.concat(F.lit("find MEM, "), F.lit("topic-"), q % 7).alias("query"))


V.SQL["found"] = """
SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(list_cosine_similarity(q, e), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, e), 9) DESC, id) AS rank
  FROM cents JOIN mstore ON user_id = query_id WHERE active) WHERE rank <= 20 AND score >= 0.35"""


@query("h11_search_memories", V.ctes("mstore", "vecs", "cents", "found") + " SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM found")
def h11(spark, sf):
    found = memories.search_memories(memory_queries(spark, sf), memory_store(spark, sf), 50, max_k=20)
    return found.withColumn("score", F.round("score", 6))


@query("h12_keyword_search_memories", V.ctes("mstore") + """
SELECT user_id AS query_id, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM mstore
  WHERE active AND user_id::INTEGER % 2 = 1 AND memory ILIKE '%mem%' AND memory ILIKE '%topic-' || user_id::INTEGER % 7 || '%') WHERE rank <= 8""")
def h12(spark, sf):
    asked = memory_queries(spark, sf).withColumn("query", F.regexp_replace("query", "find ", ""))
    answered = asked.filter(F.col("query_id").cast("int") % 2 == 0)
    return memories.keyword_search_memories(asked, memory_store(spark, sf), answered, max_words=3)


@query("h13_list_memories", V.ctes("mstore") + """
SELECT user_id, id, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM mstore WHERE active) WHERE position BETWEEN 6 AND 25""")
def h13(spark, sf):
    return memories.list_memories(memory_store(spark, sf), 20, 5, max_limit=100).select("user_id", "id", "position")


@query("h14_soft_delete", V.ctes("mstore") + """
SELECT id, user_id, CASE WHEN active AND (vec_id % 4 = 0) AND vec_id % 3 <> 0 THEN 'deleted' WHEN active THEN 'active' ELSE 'deleted' END AS status, active AND (vec_id % 4 = 0) AND vec_id % 3 <> 0 AS stamped FROM mstore""")
def h14(spark, sf):
    store = memory_store(spark, sf)
    number = F.col("id").cast("bigint")
    requests = store.filter(number % 4 == 0).select("id", F.when(number % 3 == 0, "someone").otherwise(F.col("user_id")).alias("user_id"))
    return memories.soft_delete(store, requests, NOW).select("id", "user_id", "status", F.col("deleted_at").isNotNull().alias("stamped"))


@query("h15_memory_category", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'user_preference' ELSE 'project_context' END AS category FROM events")
def h15(spark, sf):
    kind = F.when(F.col("event_type") == "view", "preference").when(F.col("event_type") == "click", "profile").otherwise(F.col("event_type"))
    return V.table(spark, sf, "events").select("event_id", M.memory_category(kind).alias("category"))


@query("h16_search_sessions", V.ctes("chats") + f"""
SELECT session_id, title FROM chats WHERE contains(lower(coalesce(title, '新会话')), '话') AND ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-25'
UNION ALL SELECT 't' || session_id, title FROM chats WHERE contains(lower(coalesce(title, '新会话')), 'topic 1')""")
def h16(spark, sf):
    chats = chat_sessions(spark, sf)
    recent = sessions.search_sessions(chats, "话", True, "2024-01-25 00:00:00").select("session_id", "title")
    return recent.unionByName(sessions.search_sessions(chats, " TOPIC 1").select(F.concat(F.lit("t"), "session_id").alias("session_id"), "title"))

"""Conversations: turns, context windows, summaries, titles, ownership.

Turns are found by position, not by a window per session: a global order is laid over all messages and
neighbours meet in a hash join, so that a session with very many messages is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import strip
from lodestone.sources.tables import numbered

RECENT_TURNS = 6
TRIGGER_TURNS = 10
# The wording of a fallback summary.
SUMMARY_HEADER = "新增历史摘要："
SUMMARY_LINE = ("- 用户询问：", "；助手回答：")


def pair_turns(messages: DataFrame) -> DataFrame:
    """``(session_id, turn_no, user_text, assistant_text)``: a user message directly followed by an
    assistant's.  ``messages(session_id, created_at, id, role, content)``."""
    placed = numbered(messages.select("session_id", "created_at", "id", "role", "content"), ["session_id", "created_at", "id"])
    users = placed.filter("role = 'user'").select("session_id", "position", F.col("content").alias("user_text"))
    answers = placed.filter("role = 'assistant'").select(
        "session_id", (F.col("position") - 1).alias("position"), F.col("content").alias("assistant_text"))
    turns = numbered(users.join(answers, ["position", "session_id"]).withColumnRenamed("position", "at"), "at")
    first = turns.groupBy("session_id").agg(F.min("position").alias("_first"))
    return turns.join(first, "session_id").select(
        "session_id", (F.col("position") - F.col("_first")).alias("turn_no"), "user_text", "assistant_text")


def memory_context(turns: DataFrame, memory: DataFrame, recent: int = RECENT_TURNS, trigger: int = TRIGGER_TURNS) -> DataFrame:
    """The raw turns a session still shows, with its totals: all up to the trigger, else the last few.

    ``memory(session_id, summary, summarized_turn_count)``.
    """
    totals = turns.groupBy("session_id").agg(F.count("*").alias("total_turns"))
    sized = turns.join(totals, "session_id").join(
        memory.select("session_id", F.col("summarized_turn_count").alias("_done")), "session_id", "left")
    long = F.col("total_turns") > trigger
    shown = sized.filter(~long | (F.col("turn_no") >= F.col("total_turns") - recent))
    done = F.coalesce("_done", F.lit(0)).cast("bigint")
    compressed = F.when(long, F.greatest(done, F.col("total_turns") - recent)).otherwise(done)
    return shown.withColumn("compressed_turns", compressed).drop("_done")


def summary_slice(turns: DataFrame, memory: DataFrame, recent: int = RECENT_TURNS, trigger: int = TRIGGER_TURNS) -> DataFrame:
    """The turns to be summarised next: from what is summarised up to the recent ones."""
    totals = turns.groupBy("session_id").agg(F.count("*").alias("total_turns"))
    sized = turns.join(totals, "session_id").join(
        memory.select("session_id", F.col("summarized_turn_count").alias("_done")), "session_id", "left")
    done = F.coalesce("_done", F.lit(0))
    upto = F.col("total_turns") - recent
    due = (F.col("total_turns") > trigger) & (F.col("turn_no") >= done) & (F.col("turn_no") < upto)
    return sized.filter(due).withColumn("summarized_turn_count", upto).drop("_done", "total_turns")


def fallback_summary(slices: DataFrame, memory: DataFrame) -> DataFrame:
    """``(session_id, summary, summarized_turn_count)``: the old summary, a header, a line per new turn."""
    asked, answered = SUMMARY_LINE
    line = F.concat(F.lit(asked), F.substring("user_text", 1, 120), F.lit(answered), F.substring("assistant_text", 1, 160))
    lines = slices.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("_new"),
        F.max("summarized_turn_count").alias("summarized_turn_count"))
    old = memory.select("session_id", F.nullif(strip(F.coalesce("summary", F.lit(""))), F.lit("")).alias("_old"))
    return lines.join(old, "session_id", "left").select(
        "session_id", strip(F.concat_ws("\n", "_old", F.lit(SUMMARY_HEADER), "_new")).alias("summary"), "summarized_turn_count")


def session_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with a default title take the start of their first user message."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(
        F.min_by("content", F.struct("created_at", "id")).alias("_first"))
    joined = sessions.join(first, "session_id", "left")
    short = strip(F.substring("_first", 1, 30))
    made = F.when(F.length("_first") > 30, F.concat(short, F.lit("..."))).otherwise(short)
    untitled = (F.col("title") == model.DEFAULT_SESSION_TITLE) & F.col("_first").isNotNull()
    return joined.withColumn("title", F.when(untitled, made).otherwise(F.col("title"))).drop("_first")


def user_sessions(sessions: DataFrame, user_id: str | None = None) -> DataFrame:
    return sessions if user_id is None else sessions.filter(F.col("user_id") == user_id)


def session_ownership(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``state`` to ``requests(session_id, user_id)``: own, foreign or new."""
    owners = sessions.select("session_id", F.col("user_id").alias("_owner"))
    state = F.when(F.col("_owner").isNull(), "new").when(F.col("_owner") == F.col("user_id"), "own").otherwise("foreign")
    return requests.join(owners, "session_id", "left").withColumn("state", state).drop("_owner")


def clear_sessions(sessions: DataFrame, messages: DataFrame, memory: DataFrame,
                   requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sessions their owners asked to clear."""
    own = session_ownership(requests, sessions).filter("state = 'own'").select("session_id").distinct()
    return tuple(table.join(own, "session_id", "left_anti") for table in (sessions, messages, memory))


def search_sessions(sessions: DataFrame, keyword: str = "", recent_only: bool = False, now: str | None = None) -> DataFrame:
    """Sessions whose title holds the keyword, newest first, optionally of the last seven days."""
    when = F.coalesce("updated_at", "created_at")
    title = F.lower(F.coalesce(F.nullif("title", F.lit("")), F.lit(model.UNTITLED_SESSION)))
    found = sessions.filter(title.contains(keyword.strip().lower()))
    if recent_only:
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        found = found.filter((when <= at) & (when >= at - F.expr("INTERVAL 7 DAYS")))
    return found.orderBy(when.desc(), "session_id")

"""Conversation streams: turns and the slices that are due for a summary.

State per session is small and bounded: a pending user message, or the turns not yet summarised.  Rows of a
micro-batch are put in time order before they meet the state.  With ``idle``, a session whose last row is that far behind the
watermark is over: its state is removed.  A session that goes on after that starts as a new one, and rows behind the watermark
are dropped, as in any windowed stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.sessions import RECENT_TURNS, TRIGGER_TURNS
from lodestone.streaming.expiry import LATE, expiring


def _idle_ms(stream: DataFrame, idle: str | None) -> int | None:
    """Milliseconds of an interval such as ``'2 hours'``."""
    if idle is None:
        return None
    length = F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))
    return stream.sparkSession.range(1).select(length.alias("ms")).first()["ms"]


def _paired(key, rows, state):
    pending, count = state or (None, 0)
    turns = []
    rows = rows.sort_values(["created_at", "id"])
    for role, content in zip(rows["role"], rows["content"]):
        if role == "assistant" and pending is not None:
            turns.append((key, count, pending, content))
            count += 1
        pending = content if role == "user" else None
    return turns, (pending, count)


def stream_pair_turns(messages: DataFrame, idle: str | None = None, late: str = LATE) -> DataFrame:
    """``(session_id, turn_no, user_text, assistant_text)`` of ``messages(session_id, created_at, id, role, content)``.

    ``idle`` needs ``created_at`` to be a timestamp.  A turn number counts the turns of a session since its state began.
    """
    return expiring(messages, "session_id", "created_at", late, _paired, "session_id string, turn_no bigint, user_text string, assistant_text string",
                    "pending string, turns bigint", _idle_ms(messages, idle))


def stream_summary_slices(turns: DataFrame, recent: int = RECENT_TURNS, trigger: int = TRIGGER_TURNS, idle: str | None = None, late: str = LATE) -> DataFrame:
    """``(session_id, turn_no, user_text, assistant_text, summarized_turn_count)``: emitted whenever a session
    has more turns than the trigger and some before the recent ones are not summarised.

    ``idle`` needs a timestamp ``created_at`` beside the turns.
    """
    def due(key, rows, state):
        total, asked, answered = state or (0, [], [])
        rows = rows.sort_values("turn_no")
        asked, answered = list(asked) + rows["user_text"].tolist(), list(answered) + rows["assistant_text"].tolist()
        total += len(rows)
        done = total - len(asked)
        ready = total - recent - done if total > trigger else 0
        out = [(key, done + i, asked[i], answered[i], total - recent) for i in range(max(ready, 0))]
        return out, (total, asked[len(out):], answered[len(out):])

    return expiring(turns, "session_id", "created_at", late, due,
                    "session_id string, turn_no bigint, user_text string, assistant_text string, summarized_turn_count bigint",
                    "total bigint, asked array<string>, answered array<string>", _idle_ms(turns, idle))

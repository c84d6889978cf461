"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags per segment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """How each role's turn is written, which roles carry loss, and which role may follow which.

    ``opens`` maps a role to the text before its turn, ``closes`` is the text after any turn.  ``other`` opens turns of a role
    without an entry; the role's name follows it up to the end of the line.  ``follows`` is the machine: from the state after a role (``start`` at first) the
    roles that may come next; ``ends`` are the states in which a conversation may stop.
    """
    opens: tuple[tuple[str, str], ...] = (("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    other: str = "### Role "
    closes: str = " </turn>\n"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, tuple[str, ...]], ...] = ((START, ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    ends: tuple[str, ...] = ("assistant",)
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def controls(self) -> list[str]:
        """What a text must not hold unescaped: the marks without the blanks around them."""
        return sorted({m.strip() for m in (*(t for _, t in self.opens), self.other, self.closes)}, key=lambda m: (-len(m), m))

    @cached_property
    def _guarded(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, [self.escape, *self.controls])))

    @cached_property
    def _reader(self) -> re.Pattern:
        marks = [*(t for _, t in self.opens), self.other, self.closes]
        return re.compile("(?s)" + re.escape(self.escape) + "(.)|(" + "|".join(map(re.escape, sorted(marks, key=lambda m: (-len(m), m)))) + ")")

    def guard(self, text: str) -> str:
        """An escape character before every control string and every escape character."""
        return self._guarded.sub(lambda m: self.escape + m[0], text)

    def opening(self, role: str) -> str:
        known = dict(self.opens)
        return known[role] if role in known else self.other + self.guard(role).replace("\n", self.escape + "\n") + "\n"

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The three segments of a turn, in order: only the text itself can carry loss."""
        return [(self.opening(role), False), (self.guard(text), role in self.loss), (self.closes, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """``(role, text)`` of each turn in a formatted text: the inverse of ``segments``."""
        roles = {t: r for r, t in self.opens}
        turns, role, parts, named, at = [], None, [], False, 0
        for m in self._reader.finditer(formatted):
            plain = formatted[at:m.start()]
            if named and "\n" in plain:  # the name of another role ends at its line's end
                name, plain = plain.split("\n", 1)
                role, parts, named = "".join([*parts, name]), [], False
            parts.append(plain)
            at = m.end()
            if m[1] is not None:
                parts.append(m[1])
            elif m[2] == self.closes:
                turns.append((role, "".join(parts)))
                role, parts = None, []
            elif m[2] in roles:
                role, parts = roles[m[2]], []
            else:
                role, parts, named = None, [], True
        return turns

    def step(self, state: str, role: str | None) -> str | None:
        """The state after ``role``, or null where it may not come; from null nothing comes back."""
        table = self._cache.setdefault("table", {s: set(r) for s, r in self.follows})
        return role if state is not None and role in table.get(state, ()) else None


def _format(template: Template):
    """Turns come in order; the machine's state is all that is held of a conversation."""
    names = ["conv_id", "turn_no", "turn", "segment", "role", "text", "loss", "state", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, number = object(), START, 0
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            rows = zip(*(batch.column(c).to_pylist() for c in ("_conv", "_turn", "_role", "_text")), strict=True)
            picked = []
            for i, (conv, turn, role, text) in enumerate(rows):
                if conv != current:
                    current, state, number = conv, START, 0
                state = template.step(state, role)
                for part, (piece, loss) in enumerate(template.segments(role or "", text)):
                    picked.append(i)
                    for name, value in zip(names[1:], (number, turn, part, role, piece, loss, state, state is not None), strict=True):
                        out[name].append(value)
                number += 1
            columns = [batch.column("_conv").take(pa.array(picked, pa.int64()))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
            columns += [pa.array(out[n], k) for n, k in zip(names[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def chat_segments(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Three rows a turn: ``(conv_id, turn_no, turn, segment, role, text, loss, state, valid)``.

    The texts of a conversation's rows, ordered by ``turn_no`` and ``segment`` and put end to end, are the formatted
    conversation; ``loss`` marks those that count for training.  ``state`` is the machine's state after the turn and is null from
    the first turn that may not come; ``valid`` says whether it is set.  Invalid conversations are formatted all the same.

    Turns are ordered by ``turn`` (null first), then role and text; repeated rows are turns of their own.  A null text
    is empty, a null role is the unknown role, a null conversation is one of its own.  Conversations are sorted on
    disk and read as a stream, so a very long one needs no more memory than a short one.  Other columns are ignored; an
    empty table gives an empty result.
    """
    template = template or Template()
    kind = turns.schema[conv].dataType.simpleString()
    laid = turns.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.col(role).cast("string").alias("_role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    laid = laid.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    schema = f"conv_id {kind}, turn_no long, turn long, segment int, role string, text string, loss boolean, state string, valid boolean"
    return laid.mapInArrow(_format(template), schema)


def _digest(template: Template):
    """Reads segments as a stream: turns back from what was written, digests of the turns and of the loss texts."""
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: dict = {}
        turn: list[tuple[str, bool]] = []
        unescape = re.compile("(?s)" + re.escape(template.escape) + "(.)")

        def close_turn():
            for role, text in template.read("".join(piece for piece, _ in turn)):
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["n"] += 1
            for piece, loss in turn:
                state["chars"] += len(piece)
                if loss:
                    plain = unescape.sub(lambda m: m[1], piece)
                    state["loss"].update(plain.encode())
                    state["loss_chars"] += len(plain)
            turn.clear()

        def close():
            if state:
                close_turn()
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["valid"]))

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss", "state", "valid")), strict=True)
            for conv, segment, text, loss, after, valid in rows:
                if not state or conv != state["conv"]:
                    close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                elif segment == 0:
                    close_turn()
                turn.append((text, loss))
                state["valid"] = valid and after in template.ends
            if len(done) > 5000:
                yield _rows(done, names, kind)
                done = []
        close()
        if done:
            yield _rows(done, names, kind)

    return run


def _rows(done: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)


def chat_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)`` read back from ``segments``.

    Segments lie in the order in which ``chat_segments`` made them, so this adds no shuffle.  ``valid`` also asks that
    the conversation ends in one of the template's end states.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return segments.mapInArrow(_digest(template or Template()), schema)

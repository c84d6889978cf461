"""Secret scans: all rules in one deterministic automaton over the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.automaton import Automaton, Expression, StartAutomaton, compile_expressions, compile_starts
from lodestone.llm.batches import pieces


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` with ``least`` characters or more after what ``head`` matches at their start."""
    kind: str
    pattern: str
    least: int = 1
    any_case: bool = False
    never_after: str = ""
    head: str = ""


# fixed values: rules of the base contract, in their order
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True,
         head=r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""),
    # a run that is too short holds no match that starts later, so the least length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}", never_after="0123456789abcdef"),
)
# further kinds of credentials
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Bytes of a block whose states are held at once; each is read as lanes side by side.
LANE_BYTES = 1 << 20
LANES, WARM_UP = 2048, 16
#: Counts above this are cut in the automaton that finds starts.
START_COUNTS = 4
#: A walk that ends without a match leaves a note at every such byte, so that others stop there.
NOTE_BYTES = 16


@cache
def automaton_of(rules: tuple[Rule, ...]) -> Automaton:
    return compile_expressions([Expression(r.pattern, r.any_case, r.never_after) for r in rules])


@cache
def starts_of(rules: tuple[Rule, ...]) -> StartAutomaton:
    return compile_starts([Expression(r.pattern, r.any_case) for r in rules], START_COUNTS)


@cache
def _tables(rules: tuple[Rule, ...]):
    a = automaton_of(rules)
    return a.step.reshape(-1).tolist(), a.accepts.tolist(), a.reaches.tolist(), a.opening.tolist()


@cache
def _allowed(rules: tuple[Rule, ...]) -> np.ndarray:
    """By byte, the rules whose match may stand right behind it."""
    return np.array([sum(1 << i for i, r in enumerate(rules) if chr(b) not in r.never_after) for b in range(256)], np.int64)


@cache
def _heads(rules: tuple[Rule, ...]) -> list[re.Pattern[bytes] | None]:
    return [re.compile(r.head.encode()) if r.head else None for r in rules]


def _states(symbols: np.ndarray, a: StartAutomaton, entry: int) -> np.ndarray:
    """The state after each symbol, read from the right, where ``entry`` is the state to the right of the last.

    The symbols are cut into lanes that are read side by side.  A lane begins with the state that the first symbols of the
    lane to its right lead to, which is nearly always the true one; where it is not, the lane is read again until both agree.
    """
    steps = max(64, -(-len(symbols) // LANES))
    n = -(-len(symbols) // steps)
    grid = np.full(n * steps, a.border, np.int32)
    grid[n * steps - len(symbols):] = symbols
    grid = np.ascontiguousarray(grid.reshape(n, steps).T)
    flat, width = a.step.reshape(-1), a.step.shape[1]
    state = np.zeros(n, np.int32)
    for row in grid[min(WARM_UP, steps) - 1::-1]:
        state = flat[state * width + np.roll(row, -1)]
    state[-1] = entry
    begun = state.tolist()
    out = np.empty((steps, n), np.int32)
    for t in range(steps - 1, -1, -1):
        state = flat[state * width + grid[t]]
        out[t] = state
    step = None
    for lane in range(n - 2, -1, -1):
        true = int(out[0, lane + 1])
        if true != begun[lane]:
            step = step or flat.tolist()
            column, seen = grid[:, lane].tolist(), out[:, lane].tolist()
            for t in range(steps - 1, -1, -1):
                true = step[true * width + column[t]]
                if true == seen[t]:
                    break
                seen[t] = true
            out[:, lane] = seen
    return out.T.reshape(-1)[n * steps - len(symbols):]


def _starts(texts: list[bytes], rules: tuple[Rule, ...], a: StartAutomaton) -> list[list[tuple[int, int]]]:
    """For each text ``(position, rules)`` where a match may start, in order: one pass over the bytes for all rules."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    symbols = a.kind[data]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    symbols[begins[1:-1] - 1] = a.border
    hit = a.accepts != 0
    places, masks, entry = [], [], 0
    for high in range(len(symbols), 0, -LANE_BYTES):
        low = max(0, high - LANE_BYTES)
        states = _states(symbols[low:high], a, entry)
        entry = int(states[0])
        at = np.flatnonzero(hit[states])
        before = np.where(at + low > 0, data[at + low - 1], 0x20)  # texts stand behind a line feed
        mask = a.accepts[states[at]] & _allowed(rules)[before]
        at, mask = at[mask != 0], mask[mask != 0]
        places.append(at + low)
        masks.append(mask)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if places:
        at, mask = np.concatenate(places[::-1]), np.concatenate(masks[::-1])
        owner = np.searchsorted(begins, at, side="right") - 1
        for d, p, m in zip(owner.tolist(), (at - begins[owner]).tolist(), mask.tolist(), strict=True):
            out[d].append((p, m))
    return out


def _matches(text: bytes, starts: list[tuple[int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """``(start, end, rule)`` in bytes: per rule the leftmost longest matches that do not overlap, short ones dropped.

    Starts that fail because of a count may be many on one long run; where two walks are in the same state at the same byte, the
    second learns from the first, so the whole stays linear.
    """
    step, accepts, reaches, opening = _tables(rules)
    heads = _heads(rules)
    free = [0] * len(rules)
    failed: dict[tuple[int, int], int] = {}
    found = []
    for start, wanted in starts:
        for r, at in enumerate(free):
            if at > start:
                wanted &= ~(1 << r)
        state, at, ends = opening[text[start - 1]] if start else opening[0x20], start, {}
        trail = []
        while wanted & reaches[state] and at < len(text):
            state = step[state << 8 | text[at]]
            at += 1
            if not at % NOTE_BYTES:
                if not wanted & reaches[state] & ~failed.get((at, state), 0):
                    break
                trail.append((at, state))
            if hit := accepts[state] & wanted:
                ends[hit] = at
                trail.clear()
        for note in trail:
            failed[note] = failed.get(note, 0) | wanted
        best: dict[int, int] = {}
        for hit, end in ends.items():
            for r in range(len(rules)):
                if hit >> r & 1:
                    best[r] = max(end, best.get(r, 0))
        for r, end in best.items():
            free[r] = end
            head = heads[r].match(text, start, end).end() if heads[r] else start
            if end - head >= rules[r].least:
                found.append((start, end, r))
    return sorted(found, key=lambda m: (m[0], m[2]))


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not found or text.isascii():
        return found
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[s]), int(before[e]), r) for s, e, r in found]


def _redacted(text: bytes, found: list[tuple[int, int, int]], mark: bytes) -> bytes:
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return b"".join([*out, text[at:]]) if out else text


def scan_batch(texts: list[bytes], rules: tuple[Rule, ...], starts: StartAutomaton | None = None) -> list[list[tuple[int, int, int]]]:
    """Byte spans of each text."""
    found = _starts(texts, rules, starts or starts_of(rules))
    return [_matches(t, at, rules) if at else [] for t, at in zip(texts, found, strict=True)]


def secret_spans(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans",
                 redact: str | None = None) -> DataFrame:
    """``docs`` with ``name``: kind, start and end (code points, end exclusive), by start, then in the rules' order.

    Per rule these are the leftmost longest matches that do not overlap, less those too short; different rules may
    overlap.  A null or empty text has an empty array and stays as it is.  With ``redact`` each covered part of ``text``
    is replaced by that mark, overlapping spans by one.  All other columns pass through unchanged, repeated
    rows give repeated rows, and a column of the same name as ``name`` is replaced.
    """
    rest = [c for c in docs.columns if c != name]
    starts = starts_of(rules)  # made once, not by every worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in rules]
        for batch in pieces(batches, text):
            raw = [t.as_py() for t in batch.column(text).cast(pa.large_binary())]
            spans = scan_batch([t or b"" for t in raw], rules, starts)
            flat = [m for t, found in zip(raw, spans, strict=True) for m in _points(t or b"", found)]
            values = pa.StructArray.from_arrays(
                [pa.array([kinds[r] for _, _, r in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, e, _ in flat], pa.int64())],
                ["kind", "start", "end"])
            offsets = np.concatenate(([0], np.cumsum([len(found) for found in spans]))).astype(np.int32)
            columns = {c: batch.column(c) for c in rest}
            if redact is not None:
                mark = redact.encode()
                columns[text] = pa.array([None if t is None else _redacted(t, found, mark).decode() for t, found in zip(raw, spans, strict=True)], columns[text].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.ListArray.from_arrays(pa.array(offsets), values)], [*rest, name])

    schema = docs.select(*rest, F.lit(None).cast(SPANS).alias(name)).schema
    return docs.select(*rest).mapInArrow(run, schema)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([r.kind for r in rules]))

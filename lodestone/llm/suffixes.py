"""Suffix-array dedup over bytes: sparse positions get ranks, pairs of ranks at growing offsets get new ones.

A full suffix array ranks every byte position.  Here the first ranks go to chosen positions only, those of the anchors
of ``windows``: each string of the threshold's length holds one at a place that depends on its own bytes.  Ranks are
names (64-bit hashes) instead of ordinals, since only their equality is asked for, and unique ranks leave at once:

1. rank of the ``anchor`` bytes at each chosen position; positions whose rank is unique are done;
2. that rank is paired with the rank of the stretch around it, which is longer than the threshold, and positions are
   sorted by the pair: equal pairs are past the threshold;
3. where one first rank has unequal stretches, byte positions of one example of each get the rank of the half of
   the threshold's length that begins there, unique ones leave, and the rank is paired with that of the half at that offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sketches import BLOBS, Shape, bit_sets, blobs_of, in_all_rows, merged
from lodestone.llm.substrings import keyed, unpacked, with_spans
from lodestone.llm.windows import Hashes, Stretches, covered, gathered, mixed_bits, stretches_of, text_codes
from lodestone.session import cut_lineage


@dataclass(frozen=True)
class Threshold:
    """Bytes of a repeated string, bytes of the first rank, the fixed size of the sets that screen positions, and the
    most examples of one first rank that are compared within a task; more of them are compared by a shuffle."""
    length: int = 200
    anchor: int = 50
    shape: Shape = Shape(2, 26)
    together: int = 4096


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _first_ranks(cfg: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = (text_codes(t.as_py()) for t in batch.column("_text").cast(pa.large_binary()))
            for _, _, laid, ends in gathered(codes, cfg.length):
                yield pa.RecordBatch.from_arrays([_long(stretches_of(laid, ends, cfg.length, cfg.anchor).anchor)], ["name"])

    return run


def _screen(shape: Shape):
    """A partition's names as a bit set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield blobs_of(batch.column("name").to_numpy().view(np.uint64), shape, TaskContext.get().partitionId())

    return run


def _identity(found: Stretches, low: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """A name for one stretch of one text."""
    return found.whole ^ mixed_bits(low.astype(np.uint64)) ^ mixed_bits(twins.view(np.uint64))


def _dealt(columns: dict[str, pa.Array], anchor: np.ndarray, whole: np.ndarray, identity: np.ndarray) -> dict[str, pa.Array]:
    """Adds ``local`` and ``deal``: where positions are sent to.

    Positions that have an equal in the same batch are known to be repeated.  They are dealt out by their own names, and
    one of them goes to its first rank for all, so a very common string is no large group there.
    """
    _, first, inverse, counts = np.unique(whole ^ mixed_bits(anchor), return_index=True, return_inverse=True, return_counts=True)
    equal = np.flatnonzero(counts[inverse] > 1)
    rows = np.concatenate((equal, first))
    local = np.concatenate((np.ones(len(equal), bool), np.zeros(len(first), bool)))
    out = {name: column.take(pa.array(rows)) for name, column in columns.items()}
    return out | {"local": pa.array(local), "deal": _long(np.where(local, mixed_bits(identity[rows]), anchor[rows]))}


def _positions(cfg: Threshold, bits, bodies: bool):
    """Chosen positions that the bit set knows: by first rank, or, with the bytes of their stretch, by identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins = batch.column("_key"), batch.column("_twin")
            own = twins.to_numpy()
            texts = batch.column("_text").cast(pa.large_binary())
            for numbers, offsets, laid, ends in gathered((text_codes(t.as_py()) for t in texts), cfg.length):
                found = stretches_of(laid, ends, cfg.length, cfg.anchor)
                if not len(found.low):
                    continue
                begins = np.concatenate(([0], ends[:-1]))
                rows, shift = np.array(numbers)[found.sequence], np.array(offsets)[found.sequence] - begins[found.sequence]
                low, high = found.low + shift, found.high + shift
                identity = _identity(found, low, own[rows])
                keep = np.flatnonzero(in_all_rows(bits.value, identity if bodies else found.anchor, cfg.shape))
                if not len(keep):
                    continue
                at, rows, low, high = pa.array(rows[keep]), rows[keep], low[keep], high[keep]
                columns = {"_key": keys.take(at), "_twin": twins.take(at), "low": _long(low), "anchor": _long(found.anchor[keep])}
                if bodies:
                    cut, last, text = [], -1, b""
                    for row, lo, hi in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
                        if row != last:
                            last, text = row, texts[row].as_py()
                        cut.append(text[lo:hi + cfg.length])
                    columns |= {"lead": _long(found.at[keep] - found.low[keep]), "body": pa.array(cut, pa.binary())}
                else:
                    columns |= {"high": _long(high), "whole": _long(found.whole[keep]), "name": _long(identity[keep])}
                    columns = _dealt(columns, found.anchor[keep], found.whole[keep], identity[keep])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads positions in order of their pair of ranks; two rows at most are carried on.

    Rows whose pair another row has come out with ``past`` set, those known before as well.  Of a first rank with unequal stretches the first row of
    each stretch comes out as an example, without ``past``.
    """
    held: pa.Table | None = None
    past, told = np.zeros(0, bool), np.zeros(0, bool)

    def settle(table: pa.Table, past: np.ndarray, told: np.ndarray, last: bool):
        anchor, whole = (table.column(c).to_numpy() for c in ("anchor", "whole"))
        same_anchor = anchor[1:] == anchor[:-1]
        same = same_anchor & (whole[1:] == whole[:-1])
        before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
        now = (before | after) & ~past
        starts = np.flatnonzero(np.concatenate(([True], ~same_anchor)))
        kinds = np.add.reduceat((~before).astype(np.int64), starts)
        unequal = np.repeat(kinds > 1, np.diff(np.concatenate((starts, [len(anchor)]))))
        example = ~before & unequal & ~told
        out = [table.take(pa.array(np.flatnonzero(m))).select(["_key", "_twin", "low", "high", "name"]).append_column("past", pa.array(np.full(int(m.sum()), flag)))
               for m, flag in ((now, True), (example, False)) if m.any()]
        ends = sorted({int(starts[-1]), len(anchor) - 1})
        # the last row's own stretch has had its example, or needs none unless the first rank turns out unequal
        rest = [(past | now)[ends], (told | example)[ends] | np.array([i != starts[-1] for i in ends])]
        return [b for t in out for b in t.to_batches()], None if last else table.take(pa.array(ends)), *rest

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            known = table.filter(table.column("local")).select(["_key", "_twin", "low", "high", "name"])
            if known.num_rows:
                yield from known.append_column("past", pa.array(np.ones(known.num_rows, bool))).to_batches()
            table = table.filter(pc.invert(table.column("local")))
            if not table.num_rows:
                continue
            fresh = np.zeros(table.num_rows, bool)
            if held is not None:
                table = pa.concat_tables([held, table])
            out, held, past, told = settle(table, np.concatenate((past, fresh)), np.concatenate((told, fresh)), False)
            yield from out


def _compared(cfg: Threshold, batch_rows: int = 2048):
    """Examples in order of their first rank: their byte positions are ranked by halves of the threshold's length.

    Runs of positions with a repeated pair come out with ``low`` and ``high``.  Where one first rank has too many
    examples to hold, the pairs themselves come out.
    """
    half, names = cfg.length // 2, ["_key", "_twin", "low", "high", "anchor", "place", "one", "two"]

    def positions(table: pa.Table):
        codes = [text_codes(b) for b in table.column("body").to_pylist()]
        sizes = np.array([len(c) for c in codes])
        begins, counts = np.cumsum(sizes) - sizes, sizes - cfg.length + 1
        hashes = Hashes(np.concatenate(codes))
        rows = np.repeat(np.arange(len(codes)), counts)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[rows] + step
        low, lead, anchor = (table.column(c).to_numpy()[rows] for c in ("low", "lead", "anchor"))
        return rows, low + step, anchor, lead - step, hashes, starts

    def shared(*ranks: np.ndarray) -> np.ndarray:
        order = np.lexsort(ranks)
        equal = np.logical_and.reduce([r[order][1:] == r[order][:-1] for r in ranks])
        out = np.zeros(len(order), bool)
        out[order] = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        return out

    def rows_of(table: pa.Table, rows, low, high, anchor=None, place=None, one=None, two=None) -> pa.RecordBatch:
        at, none = pa.array(rows), pa.nulls(len(rows), pa.int64())
        keys = table.select(["_key", "_twin"]).take(at).combine_chunks()
        more = [none if x is None else _long(x) for x in (anchor, place, one, two)]
        return pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in ("_key", "_twin")), _long(low), _long(high), *more], names)

    def within(table: pa.Table) -> pa.RecordBatch:
        rows, low, anchor, place, hashes, starts = positions(table)
        one = hashes.of(starts, starts + half)
        alive = np.flatnonzero(shared(anchor, place, one))
        two = hashes.of(starts[alive] + half, starts[alive] + cfg.length)
        alive = np.sort(alive[shared(anchor[alive], place[alive], one[alive], two)]) if len(alive) else alive
        rows, low = rows[alive], low[alive]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (low[1:] != low[:-1] + 1)))) if len(rows) else rows
        last = np.concatenate((first[1:], [len(rows)])).astype(np.int64) - 1 if len(rows) else rows
        return rows_of(table, rows[first], low[first], low[last])

    def apart(table: pa.Table) -> pa.RecordBatch:
        rows, low, anchor, place, hashes, starts = positions(table)
        return rows_of(table, rows, low, low, anchor, place, hashes.of(starts, starts + half), hashes.of(starts + half, starts + cfg.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        crowded = None
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                held.append(pa.Table.from_batches([batch.slice(at, batch_rows)]))
                table = pa.concat_tables(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                if crowded is not None:
                    end = int(np.searchsorted(anchor != crowded, True)) if (anchor != crowded).any() else len(anchor)
                    if end:
                        yield apart(table.slice(0, end))
                    table, anchor = table.slice(end), anchor[end:]
                    held = [table]
                    if not len(anchor):
                        continue
                    crowded = None
                end = len(anchor) - int(np.argmax(anchor[::-1] != anchor[-1])) if (anchor != anchor[-1]).any() else 0
                if end:
                    yield within(table.slice(0, end).combine_chunks())
                held = [table.slice(end)]
                if held[0].num_rows > cfg.together:
                    crowded = anchor[-1]
                    yield apart(held[0].combine_chunks())
                    held = []
        if held and held[0].num_rows:
            yield (within if crowded is None else apart)(pa.concat_tables(held).combine_chunks())

    return run


def repeated_spans(rows: DataFrame, cfg: Threshold) -> DataFrame:
    """``(_key, _twin, low, high)``: strings starting at bytes low to high of a text also start elsewhere."""
    spark = rows.sparkSession
    kind = rows.schema["_key"].dataType.simpleString()

    def screen(names: DataFrame):  # of a size fixed by cfg.shape
        return spark.sparkContext.broadcast(bit_sets(merged(names.mapInArrow(_screen(cfg.shape), BLOBS)), cfg.shape, "ones"))

    ranks = rows.select("_text").mapInArrow(_first_ranks(cfg), "name long")
    known = screen(ranks.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    placed = rows.mapInArrow(_positions(cfg, known, False), f"_key {kind}, _twin long, low long, anchor long, high long, whole long, name long, local boolean, deal long")
    order = ["deal", "anchor", "whole", "_key", "low"]
    paired = cut_lineage(placed.repartition("deal").sortWithinPartitions(*order).mapInArrow(_paired, f"_key {kind}, _twin long, low long, high long, name long, past boolean"))
    whole = paired.where("past").select("_key", "_twin", "low", "high")

    examples = rows.mapInArrow(_positions(cfg, screen(paired.where("not past").select("name")), True), f"_key {kind}, _twin long, low long, anchor long, lead long, body binary")
    fields = f"_key {kind}, _twin long, low long, high long, anchor long, place long, one long, two long"
    compared = cut_lineage(examples.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared(cfg), fields))
    runs = compared.where("one is null").select("_key", "_twin", "low", "high")
    alive = compared.where("one is not null")
    for ranked in (["anchor", "place", "one"], ["anchor", "place", "one", "two"]):  # offset 0, then half the length
        alive = alive.join(alive.groupBy(*ranked).agg(F.count("*").alias("_c")).where("_c > 1").select(*ranked), ranked, "left_semi")
    return whole.unionByName(runs).unionByName(alive.select("_key", "_twin", "low", "high"))


def _cut(cfg: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, spans in zip(map(unpacked, batch.column("_packed").to_pylist()), batch.column("_spans"), strict=True):
                body, found = text, spans.as_py()
                n, gone, runs = len(body), 0, 0
                if found:
                    marks, runs = covered(n, ((s["low"], s["high"] + cfg.length) for s in found))
                    gone = int(marks.sum())
                    body = np.frombuffer(body, np.uint8)[~marks].tobytes()
                for column, value in zip(columns, (n, gone, runs, body), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, cfg: Threshold | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: each text, as bytes, without what a repeated string covers.

    A string of ``cfg.length`` bytes counts as repeated if it starts anywhere else as well, in the same text or another;
    strings are judged on the input and never cross texts.  ``kept`` is binary, since a cut may fall inside a character.

    Repeated rows are separate texts, so they are removed as repeats of each other; null keys are allowed.  Null, empty and
    short texts keep all their bytes; an empty table gives an empty result; other columns are ignored.
    """
    cfg = cfg or Threshold()
    rows = keyed(docs, key, text)
    joined = with_spans(rows, repeated_spans(rows, cfg))
    kind = rows.schema["_key"].dataType.simpleString()
    return joined.mapInArrow(_cut(cfg), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

"""SimHash near-duplicates: vertical bit planes, carry-save distance counters, abandoned blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces
from lodestone.llm.components import components
from lodestone.llm.windows import mixed_bits
from lodestone.session import cut_lineage, stack

SEED = 42
BITS = 64
#: Planes added before the comparison looks for blocks to abandon.
STRIDE = 8
#: Runs of more equal keys than this are compared by themselves.
LONG_RUN = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, ASCII letters lowered; a shorter text is one run, a blank one none."""
    import xxhash

    words = text.lower().split()  # bytes.split() cuts at exactly 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    spans = zip(starts.tolist(), (ends[width - 1:] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; no hash gives zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` without ``text`` and with the 64-bit fingerprint ``name`` (a signed long); null text counts as empty."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(text).cast(pa.large_binary())
            prints = [fingerprint(shingle_hashes(t.as_py() or b"", width)) for t in texts]
            column = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [column], [*rest, name])

    schema = docs.select(*rest, F.lit(0).cast("long").alias(name)).schema
    return docs.mapInArrow(run, schema)


def block_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of which one at least is equal in two fingerprints at most ``radius`` bits apart.

    The bits are cut into ``radius + agree`` blocks; at most ``radius`` of them differ, so ``agree`` are equal.
    """
    n = radius + agree
    if n > BITS:
        return [0]
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(blocks[i] for i in chosen) for chosen in combinations(range(n), agree)]


def planes_of(prints: np.ndarray) -> np.ndarray:
    """A plane for each bit; bit j of word w of plane b is bit b of fingerprint 64 w + j.  One spare word ends each.

    ``prints`` has one 64-bit word a row, or several in columns.
    """
    n = -(-len(prints) // 64) + 1
    padded = np.zeros((n * 64, prints[:1].size if len(prints) else 1), np.uint64)
    padded[:len(prints)] = prints.reshape(len(prints), -1)
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[:len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)


def close_lanes(planes: np.ndarray, shift: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Rows i, among the set ``lanes``, whose fingerprint is within ``radius`` bits of that of row i + shift.

    All 64 rows of a block count their differing bits at once in carry-save counters; a block leaves as soon as
    each of its lanes has gone past the radius.
    """
    block = np.flatnonzero(lanes)
    alive = lanes[block]
    skip, turn = divmod(shift, 64)
    here = block + skip
    width = max(1, radius.bit_length())
    counters = np.zeros((width, len(block)), np.uint64)
    over = np.zeros(len(block), np.uint64)
    for first in range(0, len(planes), STRIDE):
        if not len(block):
            break
        for bit in range(first, first + STRIDE):
            plane = planes[bit]
            other = plane[here]
            if turn:
                other = (other >> np.uint64(turn)) | (plane[np.minimum(here + 1, planes.shape[1] - 1)] << np.uint64(64 - turn))
            carry = plane[block] ^ other
            for level in range(width):
                up = counters[level] & carry
                counters[level] ^= carry
                carry = up
            over |= carry
        # count > radius, lane by lane: compare from the highest counter bit down
        more, same = np.zeros_like(over), ~np.zeros_like(over)
        for level in reversed(range(width)):
            if radius >> level & 1:
                same &= counters[level]
            else:
                more |= same & counters[level]
                same &= ~counters[level]
        alive &= ~(over | more)
        keep = alive != 0
        if not keep.all():
            block, here, alive, over, counters = block[keep], here[keep], alive[keep], over[keep], counters[:, keep]
    if not len(block):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(bits)
    return block[word] * 64 + lane


def local_links(group: np.ndarray, prints: np.ndarray, radius: int, alike=None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within each run of equal ``group``: row numbers, and the first row of each's component.

    Row i meets row i + d for every d below the longest run; pairs that already hang together are not compared
    again, and there is at most one link a row, not one a pair.  ``alike(i, j)`` decides on pairs within the radius;
    neighbours of a run with equal ``part`` hang together from the start.
    """
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    of_row = np.repeat(sizes, sizes)
    found = [_spanned(np.flatnonzero((of_row > 1) & (of_row <= LONG_RUN)), group, prints, radius, alike, part)]
    found += [_spanned(np.arange(at, at + n), group, prints, radius, alike, part) for at, n in zip(starts, sizes, strict=True) if n > LONG_RUN]
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _spanned(rows: np.ndarray, group: np.ndarray, prints: np.ndarray, radius: int, alike=None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``local_links`` of the given rows; it ends as soon as each run hangs together."""
    if len(rows) < 2:
        return rows[:0], rows[:0]
    group, prints = group[rows], prints[rows]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((first, [len(group)])))
    head = np.repeat(first, sizes)
    planes, parent = planes_of(prints), np.arange(len(rows))
    if part is not None:
        part = part[rows]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
        parent = np.flatnonzero(new)[np.cumsum(new) - 1]
    for shift in range(1, int(sizes.max())):
        open_ = (group[shift:] == group[:-shift]) & (parent[shift:] != parent[:-shift])
        for i in close_lanes(planes, shift, _lanes(open_, planes.shape[1]), radius).tolist():
            a, b = i, i + shift
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a == b or alike is not None and not alike(rows[i], rows[i + shift]):
                continue
            parent[max(a, b)] = min(a, b)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        if np.array_equal(parent, head):
            break
    linked = np.flatnonzero(parent != np.arange(len(rows)))
    return rows[linked], rows[parent[linked]]


def _link_batches(radius: int, rows: int = 1 << 16):
    """Reads rows sorted by (band, key) and compares each run of equal keys; a run may cross batches."""
    def compare(group: list[np.ndarray], prints: list[np.ndarray], last: bool):
        g, p = np.concatenate(group), np.concatenate(prints)
        end = len(g) if last else int(np.searchsorted(np.cumsum(g[1:] != g[:-1]), (g[1:] != g[:-1]).sum())) + 1 if (g[1:] != g[:-1]).any() else 0
        a, b = local_links(g[:end], p[:end], radius)
        out = pa.RecordBatch.from_arrays([pa.array(p[x].view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])
        return out, [g[end:]], [p[end:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prints, held = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        run_no, previous = 0, None
        for batch in batches:
            band, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key"))
            if not len(band):
                continue
            new = np.concatenate(([previous is not None and (band[0], key[0]) != previous], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
            numbers = run_no + np.cumsum(new)
            run_no, previous = int(numbers[-1]), (band[-1], key[-1])
            group.append(numbers)
            prints.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(band)
            if held >= rows:
                out, group, prints = compare(group, prints, False)
                held = len(group[0]) // 2
                yield out
        yield compare(group, prints, True)[0]

    return run


def near_links(prints: DataFrame, radius: int = 4, agree: int = 2) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct ``fp`` at most ``radius`` bits apart."""
    masks = block_masks(radius, agree)
    keyed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks]))
    banded = prints.select("fp").distinct().select("fp", keyed.alias("band", "key"))
    laid = banded.repartition("band", "key").sortWithinPartitions("band", "key", "fp")
    return laid.mapInArrow(_link_batches(radius), "a long, b long")


def _grouped(prints: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """The columns of ``prints``, ``root`` and ``component_id`` from the links between nodes."""
    roots = components(links).withColumnRenamed("node", node)
    # ids are reduced by node before components meet, so a component with very many rows is no large key
    nodes = prints.groupBy(node).agg(F.min("doc_id").alias("_least")).join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    named = nodes.join(nodes.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select(node, "root", "component_id")
    return prints.join(cut_lineage(named), node).select(*prints.columns, "root", "component_id")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` for each row of ``docs``.

    Rows are near-duplicates if their fingerprints differ in ``radius`` bits or fewer, directly or over a chain of such
    rows.  ``root`` names the component by its smallest fingerprint; ``component_id`` is its smallest ``key``.  Null and
    blank texts have fingerprint zero and are linked like any other; repeated rows give repeated rows; a null key
    stays null and counts only where the component has no other.  Other columns are ignored; an empty table
    gives an empty result.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(fingerprints(slim, width=width))
    return _grouped(prints, "fp", near_links(prints, radius))


@dataclass(frozen=True)
class Wide:
    """Signatures of several words and min-hash keys for a similarity well below one.

    Rows meet if one of ``tables`` keys is equal; a key is made of the least of the shingle hashes under ``rows`` mixings, so two
    sets of similarity s share it with probability s ** rows: with these values 0.06 percent of the pairs at 0.8 share none.
    ``slack`` is the number of standard deviations by which the radius exceeds the expected distance; it is wide as
    the sets themselves decide.  A group of more than ``block`` sets is compared in pairs of blocks.
    """
    words: int = 8
    tables: int = 40
    rows: int = 8
    slack: float = 6.0
    seed: int = 9
    block: int = 512

    def radius(self, similarity: float) -> int:
        """Bits that differ at this Jaccard similarity: those of sets are at the angle acos(2 s / (1 + s))."""
        share = acos(2 * similarity / (1 + similarity)) / pi
        bits = BITS * self.words
        return round(bits * share + self.slack * (bits * share * (1 - share)) ** 0.5)


def wide_signature(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint and further ones from remixed hashes, end to end."""
    more = [hashes if w == 0 else mixed_bits(hashes ^ np.uint64(w * 0xD1342543DE82EF95 & (1 << 64) - 1)) for w in range(words)]
    return np.array([fingerprint(h) for h in more], "<u8").tobytes()


@cache
def _mixings(cfg: Wide) -> tuple[np.ndarray, np.ndarray]:
    add, times = np.random.default_rng(cfg.seed).integers(0, 1 << 64, (2, cfg.tables * cfg.rows, 1), dtype=np.uint64)
    return add, times | np.uint64(1)


def table_keys(hashes: np.ndarray, cfg: Wide) -> np.ndarray:
    """One key a table; no hash gives none."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    add, times = _mixings(cfg)
    least = np.full(len(add), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[at:at + 512] ^ add) * times).min(axis=1))
    data, step = least.astype("<u8").tobytes(), 8 * cfg.rows
    return np.array([xxhash.xxh64_intdigest(data[t * step:(t + 1) * step], t) for t in range(cfg.tables)], np.uint64).view(np.int64)


def _node(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw, SEED)


def _parts_of(batches: Iterator[pa.RecordBatch], width: int):
    """Parts of batches, with the shingle set (sorted hashes) of each row and the set's hash."""
    for part in pieces(batches, "text", rows=1024):
        sets = [np.unique(shingle_hashes(t.as_py() or b"", width)) for t in part.column("text").cast(pa.large_binary())]
        raw = [h.astype("<u8").tobytes() for h in sets]
        yield part, sets, raw, pa.array(np.array([_node(r) for r in raw], np.uint64).view(np.int64), pa.int64())


def _keys(width: int, cfg: Wide):
    """For each row the hash of its shingle set and its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, _, nodes in _parts_of(batches, width):
            keys = pa.array([table_keys(h, cfg) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), nodes, keys], ["doc_id", "text_hash", "node", "keys"])

    return run


def _sets(width: int, cfg: Wide):
    """For each text the hash of its shingle set, the signature and the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, raw, nodes in _parts_of(batches, width):
            marks = pa.array([wide_signature(h, cfg.words) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, marks, pa.array(raw, pa.binary())], ["node", "mark", "shingles"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, in order of bucket, whose bucket holds another row; one row is carried from batch to batch."""
    bucket, node, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(upto: int):
        same = bucket[1:] == bucket[:-1]
        keep = np.concatenate(([joined], same)) | np.concatenate((same, [False]))
        keep = np.flatnonzero(keep[:upto])
        return pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(node[keep])], ["bucket", "node"])

    for batch in batches:
        if batch.num_rows:
            bucket = np.concatenate((bucket, batch.column("bucket").to_numpy()))
            node = np.concatenate((node, batch.column("node").to_numpy()))
            yield out(len(bucket) - 1)
            joined = bool(bucket[-1] == bucket[-2]) if len(bucket) > 1 else joined
            bucket, node = bucket[-1:], node[-1:]
    if len(bucket):
        yield out(1)


def _alike(sets: list[np.ndarray], similarity: float):
    """Whether two of the sets have this Jaccard similarity or more."""
    def alike(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common >= similarity * (len(both) - common) - 1e-9

    return alike


def _wide_links(radius: int, similarity: float, rows: int = 1 << 10):
    """Compares the sets of each unit, rows ``(unit, part, node, mark, shingles)`` in order of (unit, part); one may cross batches.

    The signatures screen pairs, the sets decide.  What is held is bounded by ``rows`` and the largest unit.
    """
    def compare(held: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        unit, part, node = (table.column(c).to_numpy() for c in ("unit", "part", "node"))
        end = len(unit) if last else int(np.flatnonzero(unit == unit[-1])[0])
        if not end:
            return None, table.to_batches()
        marks = np.frombuffer(b"".join(table.column("mark").slice(0, end).to_pylist()), "<u8").reshape(end, -1).astype(np.uint64)
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").slice(0, end).to_pylist()]
        _, numbers = np.unique(unit[:end], return_inverse=True)
        a, b = local_links(numbers, marks, radius, _alike(sets, similarity), part[:end])
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"]), table.slice(end).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        limit = rows
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                held.append(whole.slice(at, rows))
                if sum(b.num_rows for b in held) >= limit:
                    out, held = compare(held, False)
                    limit = rows + sum(b.num_rows for b in held)
                    if out is not None:
                        yield out
        if sum(b.num_rows for b in held):
            yield compare(held, True)[0]

    return run


def _towards_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in order of (a, b): a node keeps its link to its least neighbour, and its others are linked to that one.

    Components stay the same, and the links of a group with many tables in common fall together.
    """
    node, least = None, np.int64(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
        new = np.concatenate(([node is None or a[0] != node], a[1:] != a[:-1]))
        run = np.cumsum(new) - 1
        heads = b[new]
        target = np.where(run >= 0, heads[np.maximum(run, 0)] if len(heads) else least, least)
        pairs = np.unique(np.column_stack((np.where(new, a, b), target)), axis=0)
        node, least = a[-1], target[-1]
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _met(nodes: DataFrame) -> DataFrame:
    """Links from each node to the least one of each of its keys."""
    rows = nodes.select("node", F.explode("keys").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b < _last").drop("_last")
    return rows.join(least, "bucket").select(F.col("node").alias("a"), "b").where("a <> b")


def _unit_links(units: DataFrame, nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links within each unit of ``(unit, part, node)``."""
    laid = units.join(nodes.select("node", "mark", "shingles"), "node").select("unit", "part", "node", "mark", "shingles")
    laid = laid.repartition("unit").sortWithinPartitions("unit", "part", "node")
    return cut_lineage(laid.mapInArrow(_wide_links(radius, similarity), "a long, b long"))


def set_links(met: DataFrame, nodes: DataFrame, similarity: float, cfg: Wide) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within a component of ``met`` that are ``similarity`` alike.

    Keys only say who is in one group; pairs of sets decide.  A group of up to ``cfg.block`` sets is compared as it is.  A larger one
    is dealt into blocks with its least node in each; only where these leave it in several parts does each pair of blocks meet.
    """
    radius = cfg.radius(similarity)
    found = components(met)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(cfg.block)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(cfg.seed)), F.col("blocks"))
    members = cut_lineage(members.join(sizes, "root").select("root", "node", "blocks", block.alias("block")))
    dealt = members.select("root", "node", F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")).alias("_in"))
    units = dealt.select("root", "node", F.explode("_in").alias("block")).select(F.xxhash64("root", "block").alias("unit"), F.col("node").alias("part"), "node")
    links = _unit_links(units, nodes, radius, similarity)
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    # groups that blocks leave in several parts
    parts = components(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    placed = cut_lineage(large.join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")))
    torn = placed.groupBy("root").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low < _high").select("root")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block"))).alias("other")
    pairs = placed.join(torn, "root", "left_semi").select("root", "node", "part", "block", other)
    pairs = pairs.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"), F.lit(1)).alias("unit"), "part", "node")
    # a pair of blocks that is of one part already has nothing to add
    open_ = pairs.groupBy("unit").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low < _high").select("unit")
    return stack(links, _unit_links(pairs.join(open_, "unit", "left_semi"), nodes, radius, similarity))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, cfg: Wide | None = None) -> DataFrame:
    """``(doc_id, text_hash, node, root, component_id)`` for each row: groups of texts whose shingle sets are ``similarity`` alike.

    A radius of a few bits finds little below a similarity of 0.95, so texts get wide signatures and meet by min-hash keys;
    signatures are compared bit plane by bit plane there, and the sets of those within a wide radius decide.  Groups hold
    chains of such pairs.  ``text_hash`` tells rows of one ``doc_id`` apart.  Nulls, blanks, repeats and empty tables
    are treated as in ``near_groups``.
    """
    cfg = cfg or Wide()
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(slim.mapInArrow(_keys(width, cfg), f"doc_id {kind}, text_hash long, node long, keys array<long>"))
    met = _met(cut_lineage(prints.select("node", "keys").dropDuplicates(["node"])))
    met = cut_lineage(met.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_towards_least, "a long, b long").distinct())
    # sets are made again for one text of each node that met another, so those of the whole corpus are never written
    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = prints.select("node", "text_hash").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    texts = slim.select("text", "text_hash").join(cut_lineage(chosen.select("text_hash")), "text_hash", "left_semi")
    nodes = cut_lineage(texts.mapInArrow(_sets(width, cfg), "node long, mark binary, shingles binary").dropDuplicates(["node"]))
    return _grouped(prints.select("doc_id", "text_hash", "node"), "node", set_links(met, nodes, similarity, cfg))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

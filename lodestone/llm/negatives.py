"""Hard negatives by exact integer scores: float32 products modulo small primes, put together by Chinese remainders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces
from lodestone.operators.ranking import keep_top
from lodestone.session import cut_lineage, stack

#: Squared norms stay below this, so that every score fits a long.
LARGEST_NORM = 2.0 ** 60
#: Whole numbers up to this are exact in float32.
EXACT = 1 << 24
NOTHING, ANYTHING = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of each pair, and the window of a negative's score in hundredths of the positive's.

    ``block_bytes`` of anchors are sent to the tasks at once; a task scores ``cells`` pairs at a time; one row in ``sample`` gives
    lower bounds before all rows are read, which changes no result.
    """
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block_bytes: int = 16 << 20
    cells: int = 1 << 20
    sample: int = 16


def primes_for(bound: int) -> list[int]:
    """The largest primes below 512 whose product exceeds twice ``bound``."""
    found, product = [], 1
    for p in range(511, 2, -2):
        if all(p % d for d in range(3, int(p ** 0.5) + 1, 2)):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise ValueError("scores do not fit the primes")


def residues(rows: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers held as doubles, modulo ``prime``, from ``-prime // 2`` to ``prime // 2``."""
    left = np.fmod(rows, prime)
    half = prime // 2
    left[left > half] -= prime
    left[left < -half] += prime
    return left.astype(np.float32)


def _centred(values: np.ndarray, prime: int) -> np.ndarray:
    left = values % prime
    return np.where(left > prime // 2, left - prime, left)


def product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """``left @ right.T`` modulo ``prime``: float32 throughout, in stretches of dimensions whose sums stay exact."""
    stretch = EXACT // (prime // 2) ** 2
    total = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], stretch):
        total += (left[:, at:at + stretch] @ right[:, at:at + stretch].T).astype(np.int32) % prime
    return _centred(total, prime)


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these remainders, by mixed radix digits from ``-prime // 2`` to ``prime // 2``."""
    value, weight = parts[0].astype(np.int64), primes[0]
    for part, p in zip(parts[1:], primes[1:], strict=True):
        value += _centred((part - _centred(value, p)) * pow(weight, -1, p), p) * weight
        weight *= p
    return value


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of rows given by their residues."""
    return reconstruct([product(a, b, p) for a, b, p in zip(left, right, primes, strict=True)], primes)


def _integers(part: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the usable rows of a piece, and their vectors as whole numbers in doubles."""
    lists = part.column("vector")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = lists.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(entries.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        squares = np.where(entries.is_valid().to_numpy(zero_copy_only=False), values * values, np.inf)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        norms = np.bincount(owner, weights=squares, minlength=len(sizes))
    known = [part.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("id", "label", "vector")]
    keep = np.flatnonzero(known[0] & known[1] & known[2] & (norms < LARGEST_NORM))  # false for what is not finite
    ends = np.cumsum(sizes)
    return keep, [values[ends[i] - sizes[i]:ends[i]] for i in keep.tolist()]


def _stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """One row each; missing trailing components are zero."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _sizes(scale: int):
    """Widest vector, largest squared norm and number of usable anchors of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, norm, anchors = 0, 0.0, 0
        for part in pieces(batches, "vector"):
            keep, vectors = _integers(part, scale)
            if len(keep):
                width = max(width, max(map(len, vectors)))
                norm = max(norm, max(float(v @ v) for v in vectors))
                anchors += int(part.column("anchor").take(pa.array(keep)).fill_null(False).to_numpy(zero_copy_only=False).sum())
        yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([norm]), pa.array([anchors])], ["width", "norm", "anchors"])

    return run


@dataclass
class Block:
    """Anchors with their labels and vectors, and the score windows in which rows are looked for.

    Window ``w`` belongs to anchor ``owner[w]``; windows of one anchor stand together.
    """
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class _Best:
    """The best ``k`` rows of each window so far; a window's lower bound rises with its k-th score."""

    def __init__(self, block: Block, k: int) -> None:
        self.k, self.low = k, block.low.copy()
        self.rows = np.zeros((0, 3), np.int64)  # window, score, id

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate((self.rows, np.column_stack((window, score, ids))))
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - starts
        full = place == self.k - 1
        self.low[rows[full, 0]] = np.maximum(self.low[rows[full, 0]], rows[full, 1])
        self.rows = rows[place < self.k]


def _search(shared, cfg: Mining, width: int, primes: list[int], same: bool, k: int):
    """The best rows of a partition for each window of the broadcast block: of the anchor's label if ``same``, else of others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        anchors = [residues(block.vectors, p) for p in primes]
        first = np.searchsorted(block.owner, np.arange(len(block.ids) + 1))
        most = int(np.diff(first).max(initial=0))
        ceiling = np.full(len(block.ids), NOTHING)
        np.maximum.at(ceiling, block.owner, block.high)
        best = _Best(block, k)
        side = max(1, int(cfg.cells ** 0.5))
        for part in pieces(batches, "vector"):
            keep, vectors = _integers(part, cfg.scale)
            at = pa.array(keep)
            ids, labels = (part.column(c).take(at).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            for low in range(0, len(keep), side):
                there = slice(low, low + side)
                rows = _stacked(vectors[there], width)
                theirs = [residues(rows, p) for p in primes]
                for start in range(0, len(block.ids), side):
                    here = slice(start, start + side)
                    found = scores([a[here] for a in anchors], theirs, primes)
                    floor = np.full(len(block.ids), ANYTHING)
                    lo, hi = first[start], first[min(start + side, len(block.ids))]
                    np.minimum.at(floor, block.owner[lo:hi], best.low[lo:hi])
                    fits = (block.labels[here, None] == labels[there]) == same
                    fits &= (found >= floor[here, None]) & (found <= ceiling[here, None])
                    a, r = np.nonzero(fits)
                    hit, a, r = found[a, r], a + start, r + low
                    other = block.ids[a] != ids[r]
                    hit, a, r = hit[other], a[other], r[other]
                    parts = []
                    for n in range(most):
                        w = first[a] + n
                        mine = w < first[a + 1]
                        w, score, row = w[mine], hit[mine], r[mine]
                        inside = (score >= best.low[w]) & (score <= block.high[w])
                        parts.append((w[inside], score[inside], ids[row[inside]]))
                    if sum(len(p[0]) for p in parts):
                        best.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        w = best.rows[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.ids[block.owner[w]], block.number[w], best.rows[:, 2], best.rows[:, 1])], ["anchor_id", "number", "id", "score"])

    return run


FOUND = "anchor_id long, number long, id long, score long"


def _round(rows: DataFrame, block: Block, cfg: Mining, width: int, primes: list[int], same: bool, k: int) -> DataFrame:
    """The best k of each window over all rows: ``(anchor_id, number, id, score, rank)``, written.

    A sampled part of the rows goes first: where it fills a window, its k-th score is a lower bound for the k-th of all, and
    tasks send little more than what lies above.
    """
    context, order = rows.sparkSession.sparkContext, ["anchor_id", "number"]

    def search(part: DataFrame, shared) -> DataFrame:
        return keep_top(part.mapInArrow(_search(shared, cfg, width, primes, same, k), FOUND), k, order, "id")

    shared = context.broadcast(block)
    sampled = search(rows.where(F.pmod(F.xxhash64("id"), F.lit(cfg.sample)) == 0), shared)
    bounds = sampled.where(F.col("rank") == k).select("anchor_id", "number", "score").toPandas()  # one row a window of the block at most
    place = {key: w for w, key in enumerate(zip(block.ids[block.owner].tolist(), block.number.tolist(), strict=True))}
    low = block.low.copy()
    for anchor, number, score in bounds.itertuples(index=False):
        low[place[anchor, number]] = max(low[place[anchor, number]], score)
    return cut_lineage(search(rows, context.broadcast(Block(block.ids, block.labels, block.vectors, block.owner, low, block.high, block.number))))


def hard_negatives(rows: DataFrame, anchors: Column, cfg: Mining | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: the hardest negatives of each pair.

    A component ``x`` becomes ``floor(scale * x)``; scores are integer inner products with the anchor, exact whatever the
    dimension: residues modulo some primes are multiplied in float32 and put together.  An anchor's positives are its
    ``positives`` best other rows of its label; for each of them come the ``negatives`` best rows of other labels that score at least
    ``low`` and at most ``high`` hundredths of the positive.  Ties go to the smaller key.

    ``anchors`` tells the anchors; null is no.  They are sent to the tasks in blocks of ``block_bytes``, each of which
    searches all rows; nothing is cut off.  Rows with a null key, label or vector, with null or non-finite components or with a
    squared norm of 2**60 or more (a score might leave a long) take no part.  Shorter vectors count as followed by zeros; an empty one
    scores zero with all.  Keys and labels are whole numbers.  Of several anchors with one key that with the smallest label and vector is
    used, and rows with its key are neither its positives nor its negatives; other repeated rows count each.  Other columns are
    ignored; an empty table or one label gives an empty result.
    """
    cfg = cfg or Mining()
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    spark = rows.sparkSession
    size = slim.mapInArrow(_sizes(cfg.scale), "width long, norm double, anchors long").agg(F.max("width").alias("width"), F.max("norm").alias("norm"), F.sum("anchors").alias("anchors")).first()
    width, primes = max(1, size["width"] or 0), primes_for(int((size["norm"] or 0.0) * (1 + 1e-9)) + 1)
    rounds = max(1, -(-(size["anchors"] or 0) * 8 * width // cfg.block_bytes))
    candidates = slim.select("id", "label", "vector")
    found = None
    for turn in range(rounds):
        asked = slim.where("anchor").where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn).select("id", "label", "vector").toArrow()  # about block_bytes
        block = _block(asked, cfg, width)
        if not len(block.ids):
            continue
        positives = _round(candidates, block, cfg, width, primes, True, cfg.positives)
        windows = _windows(block, positives.orderBy("anchor_id", "rank").toPandas(), cfg)  # a few rows an anchor of the block
        mined = _round(candidates, windows, cfg, width, primes, False, cfg.negatives)
        pairs = (mined.join(positives.select("anchor_id", F.col("rank").cast("long").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "number"])
                 .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        found = pairs if found is None else stack(found, pairs)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def _block(asked: pa.Table, cfg: Mining, width: int) -> Block:
    """Anchors by key, one for each, with one window that holds every score."""
    chosen: dict[int, tuple] = {}
    for batch in asked.to_batches():
        keep, vectors = _integers(batch, cfg.scale)
        ids, labels = (batch.column(c).take(pa.array(keep)).to_pylist() for c in ("id", "label"))
        for i, row in zip(ids, zip(labels, map(tuple, vectors), strict=True), strict=True):
            chosen[i] = min(chosen.get(i, row), row)
    ids = sorted(chosen)
    n = len(ids)
    return Block(np.array(ids, np.int64), np.array([chosen[i][0] for i in ids], np.int64), _stacked([np.array(chosen[i][1]) for i in ids], width),
                 np.arange(n), np.full(n, NOTHING), np.full(n, ANYTHING), np.zeros(n, np.int64))


def _windows(block: Block, positives, cfg: Mining) -> Block:
    """One window for each positive: ``low * positive <= 100 * negative <= high * positive``, numbered by rank."""
    owner = np.searchsorted(block.ids, positives["anchor_id"].to_numpy(np.int64))
    least = [-(-cfg.low * s // 100) for s in positives["score"].tolist()]  # whole numbers of any size
    most = [cfg.high * s // 100 for s in positives["score"].tolist()]
    return Block(block.ids, block.labels, block.vectors, owner, np.array(least, np.int64), np.array(most, np.int64), positives["rank"].to_numpy(np.int64))

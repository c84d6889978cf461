"""Approximate nearest neighbours over balanced posting lists, chosen by a graph of centroids and a distance ratio."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


@dataclass(frozen=True)
class Lists:
    """``sample`` vectors at most fit the index.  ``per_list`` vectors are aimed at in a list, up to ``most`` lists.

    A vector goes to its nearest list and to those at most ``spread`` times as far, ``copies`` at most.  A query reads the
    lists up to a ratio of the distance to its nearest one; the ratio is the one that would have kept ``recall`` of the
    neighbours within the sample.  About ``block`` vectors and queries meet in one group: short lists share one, longer ones
    are split.
    """
    sample: int = 20_000
    per_list: int = 100
    most: int = 4096
    spread: float = 1.3
    copies: int = 4
    recall: float = 0.96
    degree: int = 16
    block: int = 8192
    seed: int = 5


@dataclass
class Index:
    """Centroids (unit length), the neighbours of each in the graph, where a search begins, and the query ratio."""
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float

    def search(self, points: np.ndarray, ratio: float, least: int, width: int = 8) -> np.ndarray:
        """Distances to the centroids that a best-first walk over the graph meets; infinite for all others.

        Each round every point opens its ``width`` closest centroids not opened yet, until the closest one left is
        farther than ``ratio`` times the nearest found and ``least`` centroids have been opened.
        """
        n, k = len(points), len(self.centroids)
        found = np.full((n, k), np.inf, np.float32)
        opened = np.zeros((n, k), bool)

        def measure(rows: np.ndarray, ids: np.ndarray) -> None:
            dots = np.einsum("ij,ij->i", points[rows], self.centroids[ids])
            found[rows, ids] = np.sqrt(np.maximum(2 - 2 * dots, 1e-12))

        rows, ids = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)
        measure(rows, ids)
        active, width = np.arange(n), min(width, k)
        while len(active):
            left = np.where(opened[active], np.inf, found[active])
            near = np.argpartition(left, width - 1, axis=1)[:, :width]
            reach = np.take_along_axis(left, near, axis=1)
            best = found[active].min(axis=1)
            wanted = np.isfinite(reach) & ((reach <= ratio * best[:, None]) | (opened[active].sum(axis=1) < least)[:, None])
            if not wanted.any():
                break
            at, col = np.nonzero(wanted)
            who, what = active[at], near[at, col]
            opened[who, what] = True
            rows, ids = np.repeat(who, self.graph.shape[1]), self.graph[what].reshape(-1)
            fresh = np.isinf(found[rows, ids])
            measure(rows[fresh], ids[fresh])
            active = active[wanted.any(axis=1)]
        return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=-1, keepdims=True)).astype(np.float32)


def balanced_centroids(points: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of equal shares of ``points``: every share is halved at the median between two means, again and again."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(points))]
    while len(parts) < lists and min(len(p) for p in parts) >= 2:
        halves = []
        for part in parts:
            x = points[part]
            low, high = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(5):
                order = np.argsort(x @ (high - low), kind="stable")
                half = len(order) // 2
                low, high = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
            halves += [part[order[:half]], part[order[half:]]]
        parts = halves
    means = np.stack([points[p].astype(np.float64).mean(axis=0) for p in parts])
    norms = np.linalg.norm(means, axis=1)
    means = np.where(norms[:, None] > 1e-9, means, points[[p[0] for p in parts]])
    return np.unique(_unit(means), axis=0)


def _assigned(index: Index, points: np.ndarray, cfg: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, list, place)``: the nearest list (place 0) and further ones for vectors near a border."""
    parts = []
    for at in range(0, len(points), 512):  # bounds what the walk holds
        found = index.search(points[at:at + 512], cfg.spread, 2 * cfg.copies)
        near = np.argsort(found, axis=1, kind="stable")[:, :min(cfg.copies, found.shape[1])]
        reach = np.take_along_axis(found, near, axis=1)
        row, place = np.nonzero(np.isfinite(reach) & (reach <= cfg.spread * reach[:, :1]))
        parts.append((row + at, near[row, place], place))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def fit(points: np.ndarray, n: int, cfg: Lists, k: int) -> Index:
    """An index from sampled unit vectors for a table of ``n``, with the ratio measured on the sample itself."""
    rng = np.random.default_rng(cfg.seed)
    lists = 1 << max(0, round(np.log2(max(1, n / cfg.per_list))))
    lists = min(lists, cfg.most, 1 << int(np.log2(max(1, len(points) / 8)))) if len(points) >= 8 else 1
    centroids = balanced_centroids(points, lists, cfg.seed)
    near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1:cfg.degree + 1]
    far = rng.integers(0, len(centroids), (len(centroids), 2))  # long edges keep the graph in one piece
    graph = np.concatenate([near, far], axis=1)
    index = Index(centroids, graph, rng.permutation(len(centroids))[:8], 1.0)
    asked = rng.permutation(len(points))[:400]
    row, lst, _ = _assigned(index, points, cfg)
    dots = points[asked] @ points.T
    dots[np.arange(len(asked)), asked] = -2
    n_true = min(k, max(1, len(points) - 1))
    true = np.argpartition(-dots, n_true - 1, axis=1)[:, :n_true]
    to_lists = np.sqrt(np.maximum(2 - 2 * points[asked] @ centroids.T, 1e-12))
    needed = np.full((len(points), len(asked)), np.inf, np.float32)
    for j in range(len(asked)):
        np.minimum.at(needed[:, j], row, to_lists[j, lst] / to_lists[j].min())
    ratios = needed[true, np.arange(len(asked))[:, None]]
    index.ratio = max(1.0, float(np.quantile(ratios[np.isfinite(ratios)], cfg.recall, method="higher"))) if np.isfinite(ratios).any() else 1.0
    return index


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors: not null, ``dim`` long, not zero, all components finite."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = flat.reshape(-1, dim) if dim else np.zeros((0, 0))
    fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return rows[fine], values[fine]


def _route(bits, cfg: Lists, dim: int, chosen, of: str, out_id: str):
    """Rows ``(list, part, block, id, vector)``; ``chosen`` gives (row, list, place) for a batch of unit vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                rows, values = _matrix(piece.column(of), dim)
                if not len(rows):
                    continue
                row, lst, place = chosen(bits.value, _unit(values))
                take = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([pa.array(lst.astype(np.int32)), pa.array(place.astype(np.int32)), piece.column("_id").take(take), piece.column(of).take(take)], ["list", "place", out_id, of])

    return run


def _nearest(dim: int, k: int):
    """The ``k`` nearest of a shelf's vectors for each query of a block, among the lists that the query reads."""
    names = ["query_id", "vec_id", "score"]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kind = queries.schema.field("query_id").type
        none = pa.table({"query_id": pa.array([], kind), "vec_id": pa.array([], kind), "score": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return none
        order = pa.compute.sort_indices(vectors.column("vec_id"))
        ids, lists = vectors.column("vec_id").combine_chunks().take(order), vectors.column("list").to_numpy()[order.to_numpy()]
        _, x = _matrix(vectors.column("_vector").combine_chunks().take(order), dim)
        # a query comes with a row for each of its lists
        asked, read = queries.column("query_id").combine_chunks().dictionary_encode(), queries.column("list").to_numpy()
        owner = asked.indices.to_numpy()
        first = np.unique(owner, return_index=True)[1]
        _, q = _matrix(queries.column("_vector").combine_chunks().take(pa.array(first)), dim)
        asked = asked.dictionary
        numbers, column = np.unique(np.concatenate((lists, read)), return_inverse=True)
        reads = np.zeros((len(q), len(numbers)), bool)
        reads[owner, column[len(lists):]] = True
        norms, q_norms = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        place = pa.compute.index_in(asked, ids).fill_null(-1).to_numpy(zero_copy_only=False)
        times = int(np.unique(np.asarray(ids), return_counts=True)[1].max())  # lists that hold one vector, and repeated rows
        pairs = []
        for lo in range(0, len(q), 256):
            block = slice(lo, lo + 256)
            near = np.round((q[block] / q_norms[block, None]) @ (x / norms[:, None]).T, 12)
            near[~reads[block][:, column[:len(lists)]]] = -np.inf
            for i in np.flatnonzero(place[block] >= 0).tolist():  # a query's own id, which may stand in several rows
                start = stop = int(place[block][i])
                while stop < len(ids) and ids[stop] == ids[start]:
                    stop += 1
                near[i, start:stop] = -np.inf
            n = min(k * times, near.shape[1])
            kth = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
            for i in range(near.shape[0]):
                above = np.flatnonzero((near[i] >= kth[i]) & (near[i] > -np.inf))
                best = above[np.argsort(-near[i, above], kind="stable")]  # equal ones stay in the order of their ids
                seen: dict = {}
                for j in best.tolist():
                    seen.setdefault(ids[j].as_py(), j)
                    if len(seen) == k:
                        break
                pairs += [(lo + i, j) for j in seen.values()]
        if not pairs:
            return none
        i, j = np.array(pairs).T
        scores = (q[i] * x[j]).sum(axis=1) / (q_norms[i] * norms[j])
        return pa.table({"query_id": asked.take(pa.array(i)), "vec_id": ids.take(pa.array(j)), "score": pa.array(scores, pa.float64())}).select(names)

    return run


def _shelves(spark: SparkSession, held: dict[int, int], asked: dict[int, int], block: int) -> DataFrame:
    """``(list, shelf, parts, blocks)`` for each list: short lists share a shelf of at most ``block`` vectors, a long one is
    alone and split into parts; a shelf with more than ``block`` rows of queries takes them in blocks."""
    shelf, size, rows = 0, 0, []
    for lst, n in sorted(held.items()):
        if size and size + n > block:
            shelf, size = shelf + 1, 0
        rows.append((lst, shelf, -(-n // block)))
        size += n
    queries: dict[int, int] = {}
    for lst, at, _ in rows:
        queries[at] = queries.get(at, 0) + asked.get(lst, 0)
    return spark.createDataFrame([(lst, at, parts, max(1, -(-queries[at] // block))) for lst, at, parts in rows], "list int, shelf int, parts int, blocks int")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, cfg: Lists | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` holds the ``k`` rows of other ids found nearest.

    ``score`` is the cosine in double precision, computed from the vectors as given; equal scores are ranked by the smaller id.
    Every vector is in the index.  All rows are found where there are ``k`` or fewer others; otherwise each query reads
    lists with more than ``k`` vectors at least, so ``k`` come back.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors whose
    length is not the commonest (the longer at a tie).  Rows of one id are never each other's neighbours; a repeated row is
    returned once.  Other columns are ignored; an empty table gives an empty result.
    """
    cfg = cfg or Lists()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), F.coalesce(is_query, F.lit(False)).alias("_asks")).where("_id is not null and _vector is not null")
    kind = rows.schema["_id"].dataType.simpleString()
    sizes = rows.groupBy(F.size("_vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes or sizes[0]["dim"] < 1:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    # cfg.sample rows at most, whatever the table holds
    drawn = rows.where(F.size("_vector") == dim).orderBy(F.xxhash64("_id", F.lit(cfg.seed)), "_id").limit(cfg.sample).select("_vector").toArrow()
    _, sample = _matrix(drawn.column("_vector").combine_chunks(), dim)
    if not len(sample):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = fit(_unit(sample), n, cfg, k)
    shared = spark.sparkContext.broadcast(index)  # at most cfg.most centroids

    def own_lists(ix: Index, points: np.ndarray):
        return _assigned(ix, points, cfg)

    laid = f"list int, place int, vec_id {kind}, _vector array<double>"
    postings = cut_lineage(rows.select("_id", "_vector").mapInArrow(_route(shared, cfg, dim, own_lists, "_vector", "vec_id"), laid))
    # a row for each list, cfg.most at most
    held = {r["list"]: r for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("place") == 0).cast("long")).alias("first")).collect()}
    firsts = np.zeros(len(index.centroids))
    for lst, r in held.items():
        firsts[lst] = r["first"]

    def read_lists(ix: Index, points: np.ndarray):
        found = ix.search(points, ix.ratio, 32)
        order = np.argsort(found, axis=1, kind="stable")
        reach = np.take_along_axis(found, order, axis=1)
        before = np.cumsum(firsts[order], axis=1) - firsts[order]  # vectors whose nearest list is one of those before
        short = before <= k
        row, place = np.nonzero((np.isfinite(reach) & (reach <= ix.ratio * reach[:, :1])) | short)
        return row, order[row, place], place

    asks = rows.where("_asks").select("_id", "_vector").mapInArrow(_route(shared, cfg, dim, read_lists, "_vector", "query_id"), f"list int, place int, query_id {kind}, _vector array<double>")
    asks = cut_lineage(asks)
    asked = {r["list"]: r["n"] for r in asks.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # a row for each list again
    shelves = F.broadcast(_shelves(spark, {lst: r["n"] for lst, r in held.items()}, asked, cfg.block))
    all_of = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    left = postings.join(shelves, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("list", "shelf", "part", all_of("blocks").alias("block"), "vec_id", "_vector")
    right = asks.join(shelves, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select(
        "list", F.col("shelf").alias("on"), all_of("parts").alias("part"), "block", "query_id", "_vector")
    met = left.groupBy("shelf", "part", "block").cogroup(right.groupBy("on", "part", "block")).applyInArrow(_nearest(dim, k), f"query_id {kind}, vec_id {kind}, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

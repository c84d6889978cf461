"""Nearest neighbours by cosine similarity, over all vectors or within a key such as a user.

Over all vectors these stay where they are: a block of queries of bounded bytes goes to every task, which keeps the best k
per query while it reads its vectors; more queries than fit one block are answered in rounds.  Within a key, queries and
vectors meet as matrices: the vectors of a batch become one row per cell, the queries of a cell are packed in small
blocks, and an equi-join on (cell, block, salt) brings them together; a cell has as many salts as its vectors fill tasks.  No task emits a pair per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import keep_top
from lodestone.session import cut_lineage

QUERIES_PER_BLOCK = 256
BYTES_PER_PACK = 8 << 20
SALTS = 32
#: Vectors of a key that meet copies of its queries in one task, about.
VECTORS_PER_SALT = 1 << 15
#: Bytes of query vectors that are sent to every task at once.
BYTES_PER_ROUND = 32 << 20
FILTER_COLUMNS = ("category", "source_type", "doc_semantic_type", "title", "section")
QUERY_FILTERS = ("allowed", "allowed_sources", "allowed_kinds", "title_phrases", "section_phrases", "before")
#: Lists of a query and the columns of a vector that must be in them; a null or empty list admits all.
MEMBERSHIPS = (("allowed", "category"), ("allowed_sources", "source_type"), ("allowed_kinds", "doc_semantic_type"))


def _pack_vectors(bits: int, seed: int):
    """Arrow batches of vectors → one row per cell and pack, the matrix as bytes of unit vectors."""
    bytes_per_pack, names = BYTES_PER_PACK, FILTER_COLUMNS

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = flat.astype(np.float64).reshape(batch.num_rows, -1)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            if bits:
                planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], bits))
                cells = ((matrix @ planes > 0) * (1 << np.arange(bits))).sum(axis=1)
            per_pack = max(1, bytes_per_pack // (8 * matrix.shape[1]))
            rows = {name: [] for name in ("cell", "ids", "width", "matrix", "ordinal", *names)}
            for cell in np.unique(cells):
                members = np.flatnonzero(cells == cell)
                for start in range(0, len(members), per_pack):
                    part = members[start:start + per_pack]
                    rows["cell"].append(int(cell))
                    rows["ids"].append(batch.column("item_id").take(pa.array(part)).to_pylist())
                    rows["width"].append(matrix.shape[1])
                    rows["matrix"].append(matrix[part].tobytes())
                    for name in ("ordinal", *names):
                        rows[name].append(batch.column(name).take(pa.array(part)).to_pylist())
            text = pa.list_(pa.string())
            types = [pa.int64(), text, pa.int32(), pa.binary(), pa.list_(pa.int64()), *[text] * len(names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    return pack


def _admitted(query: dict, columns: dict, cache: dict):
    """A mask of the vectors that a query may see; None where it may see all.  Equal lists are looked up once."""
    import numpy as np

    masks = []
    for wanted, name in MEMBERSHIPS:
        if query.get(wanted) is not None and len(query[wanted]):
            at = (name, *query[wanted])
            if at not in cache:
                cache[at] = np.isin(np.asarray(columns[name], dtype=object).astype(str), np.asarray(query[wanted], dtype=object).astype(str))
            masks.append(cache[at])
    for wanted, name in (("title_phrases", "title"), ("section_phrases", "section")):
        if query.get(wanted) is not None and len(query[wanted]):
            at = (name, *query[wanted])
            if at not in cache:
                cache[at] = np.fromiter((t is not None and any(p in t for p in query[wanted]) for t in columns[name]), bool, len(columns[name]))
            masks.append(cache[at])
    if query.get("before") is not None:
        masks.append(np.asarray(columns["ordinal"]) < query["before"])
    return np.logical_and.reduce(masks) if masks else None


def _unit(matrix):
    import numpy as np

    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best_of_packs(k: int):
    def score(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            asked, names, values = [], [], []
            for row in frame.itertuples(index=False):
                matrix = np.frombuffer(row.matrix, dtype=np.float64).reshape(-1, row.width)
                queries = _unit(np.array([np.asarray(q["embedding"], dtype=np.float64) for q in row.queries]))
                scores = np.round(queries @ matrix.T, 9) + 0.0
                ids, cache, columns = np.asarray(row.ids, dtype=object), {}, row._asdict()
                for query, line in zip(row.queries, scores):
                    seen = _admitted(query, columns, cache)
                    found, line = (ids, line) if seen is None else (ids[seen], line[seen])
                    if len(line) > k:
                        # all ties of the k-th best go on; the final cut breaks them by id
                        least = np.partition(line, len(line) - k)[len(line) - k]
                        found, line = found[line >= least], line[line >= least]
                    asked.append(np.full(len(line), query["query_id"], dtype=object))
                    names.append(found)
                    values.append(line)
            if asked:
                yield pd.DataFrame({"query_id": np.concatenate(asked), "item_id": np.concatenate(names), "score": np.concatenate(values)})

    return score


def _best_of_scan(block, k: int):
    """Reads a partition's vectors once and keeps the best k per query of a broadcast block."""
    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        queries = block.value
        unit = _unit(np.array([q["embedding"] for q in queries], dtype=np.float64))
        best: list[tuple] = [(np.zeros(0), np.zeros(0, dtype=object))] * len(queries)
        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = _unit(flat.astype(np.float64).reshape(batch.num_rows, -1))
            ids = np.asarray(batch.column("item_id").to_pylist(), dtype=object)
            columns = {c: batch.column(c).to_pylist() for c in (*FILTER_COLUMNS, "ordinal") if c in batch.schema.names}
            cache: dict = {}
            for low in range(0, len(queries), QUERIES_PER_BLOCK):
                scores = np.round(unit[low:low + QUERIES_PER_BLOCK] @ matrix.T, 9) + 0.0
                for i, line in enumerate(scores, low):
                    seen = _admitted(queries[i], columns, cache)
                    found, line = (ids, line) if seen is None else (ids[seen], line[seen])
                    held, held_ids = best[i]
                    if len(held) >= k:
                        near = line >= held[-1]
                        found, line = found[near], line[near]
                    elif len(line) > k:
                        least = np.partition(line, len(line) - k)[len(line) - k]
                        found, line = found[line >= least], line[line >= least]
                    if len(line):
                        line, found = np.concatenate((held, line)), np.concatenate((held_ids, found))
                        order = sorted(range(len(line)), key=lambda j: (-line[j], found[j]))[:k]
                        best[i] = (line[order], found[order])
        sizes = [len(v) for v, _ in best]
        yield pa.RecordBatch.from_arrays([
            pa.array([q["query_id"] for q, n in zip(queries, sizes, strict=True) for _ in range(n)], pa.string()),
            pa.array([i for _, ids in best for i in ids], pa.string()), pa.array([v for values, _ in best for v in values], pa.float64())],
            ["query_id", "item_id", "score"])

    return score


def _search_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    spark = queries.sparkSession
    given = [c for c in QUERY_FILTERS if c in queries.columns]
    # written once, so that an embedding model is called once for each query
    asked = cut_lineage(queries.select("query_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), *given))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    rounds = -(-size["n"] * max(size["width"] or 0, 1) * 8 // BYTES_PER_ROUND)
    needed = [c for c in FILTER_COLUMNS if c in vectors.columns and given] + (["ordinal"] if "before" in given else [])
    rows = vectors.select("item_id", "embedding", *needed)
    found = None
    for turn in range(rounds):
        block = [r.asDict() for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn).where("embedding is not null").collect()]
        if not block:
            continue
        shared = spark.sparkContext.broadcast(block)  # about BYTES_PER_ROUND
        part = rows.mapInArrow(_best_of_scan(shared, k), "query_id string, item_id string, score double")
        found = part if found is None else found.union(part)
    return empty_ranking(queries) if found is None else keep_top(found, k)


def _search(queries: DataFrame, vectors: DataFrame, k: int, bits: int, flips: int, seed: int) -> DataFrame:
    def column(df: DataFrame, name: str, default) -> Column:
        return (F.coalesce(F.col(name), default) if name in df.columns else default).alias(name)

    cell = F.xxhash64("key").alias("cell") if "key" in vectors.columns else F.lit(0).cast("bigint").alias("cell")
    rows = vectors.select("item_id", "embedding", cell, column(vectors, "ordinal", F.lit(-1).cast("bigint")),
                          *[column(vectors, c, F.lit("")) for c in FILTER_COLUMNS])
    packs = rows.mapInArrow(
        _pack_vectors(bits, seed), "cell bigint, ids array<string>, width int, matrix binary, ordinal array<bigint>, " + ", ".join(f"{c} array<string>" for c in FILTER_COLUMNS))
    texts, number = F.lit(None).cast("array<string>"), F.lit(None).cast("bigint")
    wide = queries.select(
        "query_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), cell,
        *[column(queries, c, number if c == "before" else texts) for c in QUERY_FILTERS])
    if bits:
        wide = wide.withColumn("cell", F.explode(_probes(F.col("embedding"), bits, flips, seed)))
    # a block holds about QUERIES_PER_BLOCK queries of its cell: its number is a hash of a unique id
    sizes = wide.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).alias("n_blocks"))
    blocks = (wide.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")))
              .groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "embedding", *QUERY_FILTERS)).alias("queries")))
    if bits:
        salted, blocks = packs.withColumn("salts", F.lit(SALTS)), blocks.withColumn("salts", F.lit(SALTS))
    else:
        # queries of a key are copied as often as its vectors need tasks: mostly once
        spread = rows.groupBy("cell").agg(F.ceil(F.count("embedding") / VECTORS_PER_SALT).cast("int").alias("salts")).where("salts > 0")
        salted, blocks = packs.join(spread, "cell"), blocks.join(spread, "cell")
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    placed = (salted.withColumn("salt", F.pmod(F.xxhash64("matrix"), F.col("salts")).cast("int")).join(sizes, "cell")
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1))))
    met = placed.join(blocks, ["cell", "block", "salt"]).select(
        "ids", "width", "matrix", "ordinal", *FILTER_COLUMNS, "queries")
    scored = met.mapInPandas(_best_of_packs(k), "query_id string, item_id string, score double")
    return keep_top(scored, k)


def _probes(embedding: Column, bits: int, flips: int, seed: int):
    """The cells a query looks into: its own and those that differ in at most ``flips`` bits."""
    masks = [sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(bits), n)]

    def own_cells(vectors: pd.Series) -> pd.Series:
        import numpy as np

        matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], bits))
        cells = ((matrix @ planes > 0) * (1 << np.arange(bits))).sum(axis=1)
        return pd.Series([[int(c) ^ m for m in masks] for c in cells], dtype=object)

    return F.pandas_udf(own_cells, "array<bigint>")(embedding)


def empty_ranking(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id string, item_id string, score double, rank int")


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k most similar vectors per query: ``(query_id, item_id, score, rank)``.

    ``queries`` may carry allowed sources and kinds and phrases (see ``filters.dense_filters``); they are
    applied before the cut to k.  A vector is read once for each ``BYTES_PER_ROUND`` of queries.
    """
    return empty_ranking(queries) if k <= 0 else _search_all(queries, vectors, k)


def knn_within(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact search among the vectors with the query's own ``key``.

    ``vectors`` may carry an ``ordinal`` and queries ``before``: then only smaller ordinals are seen.
    """
    if k <= 0:
        return empty_ranking(queries)
    # cells are hashes of the key; the filter on the key itself keeps colliding keys apart
    return _search(queries.withColumn("allowed", F.array("key")), vectors.withColumn("category", F.col("key")), k, 0, 0, 0)


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, bits: int | None = None, flips: int | None = None, seed: int = 7) -> DataFrame:
    """Look only into cells of random hyperplanes near the query; scores inside them are exact.

    Unless given, ``bits`` follows the number of vectors, so that a cell holds some hundreds of them, and half of the
    bits may be flipped.  All vectors of the probed cells are candidates.
    """
    if k <= 0:
        return empty_ranking(queries)
    if bits is None:
        bits = min(16, max(1, round(math.log2(max(2, vectors.count()) / 500))))
    return _search(queries, vectors, k, bits, -(-bits // 2) if flips is None else flips, seed)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = exact.join(approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return found.agg(F.count("*").alias("expected"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

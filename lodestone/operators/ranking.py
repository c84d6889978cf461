"""Cuts and orders shared by all ranked relations.  Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(rows: DataFrame, order: list[Column], group: str | list[str] = "query_id", name: str = "rank") -> DataFrame:
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_top(scored: DataFrame, k: int, group: str | list[str] = "query_id", item: str = "item_id",
             score: str = "score") -> DataFrame:
    """The k best rows per group.  The literal k lets Spark cut inside each task before the shuffle."""
    ranked = with_rank(scored, [F.col(score).desc(), F.col(item)], group)
    return ranked.filter(F.col("rank") <= F.lit(max(k, 0)))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


class BestOfTask:
    """The k best of the items that one task reads, for each of ``names``; ids of equal score go by their own order, null first."""

    def __init__(self, names: list, k: int) -> None:
        import numpy as np

        self.names, self.k = names, k
        self.held = [(np.zeros(0), np.zeros(0, dtype=object))] * len(names)

    def add(self, scores, seen, ids) -> None:
        """``scores[name, item]`` where ``seen``, for the items ``ids``."""
        import numpy as np

        k, place = self.k, None
        for q in np.flatnonzero(seen.any(axis=1)):
            mine = np.flatnonzero(seen[q])
            line = scores[q, mine]
            held, held_ids = self.held[q]
            least = held[-1] if len(held) >= k else np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else None
            if least is not None:
                near = line >= least
                line, mine = line[near], mine[near]
            if len(line) > k:
                # very many items may tie: their ids are put in order once, for all names
                place = self._places(ids) if place is None else place
                first = np.lexsort((place[mine], -line))[:k]
                line, mine = line[first], mine[first]
            found = ids[mine]
            if len(line):
                line, found = np.concatenate((held, line)), np.concatenate((held_ids, found))
                order = sorted(range(len(line)), key=lambda j: (-line[j], found[j] is not None, found[j]))[:k]
                self.held[q] = (line[order], found[order])

    @staticmethod
    def _places(ids):
        import numpy as np

        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda j: (ids[j] is not None, ids[j]))] = np.arange(len(ids))
        return place

    def batch(self, query_type, item_type):
        """``(query_id, item_id, score)``."""
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([
            pa.array([n for n, (v, _) in zip(self.names, self.held, strict=True) for _ in v], query_type),
            pa.array([i for _, ids in self.held for i in ids], item_type), pa.array([v for values, _ in self.held for v in values], pa.float64())],
            ["query_id", "item_id", "score"])

"""Models of the caller: reranker, embedder, judge.

Each hook is a factory: it is called once per task and returns the function that scores a batch, so a
model is loaded once per task.  Spark partitions the rows; batches bound what the model sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _run(df: DataFrame, inputs: list[str], factory: Callable, batch: int, added: list[tuple[str, T.DataType]], keep_failed: bool) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    names = [n for n, _ in added]

    def apply(frames):
        import pandas as pd

        model = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch].copy()
                try:
                    if model is None:
                        model = factory()
                    values = list(model(*[part[c].tolist() for c in inputs]))
                    error = None
                    if len(values) != len(part):
                        raise ValueError("the model returned a different number of results")
                except Exception as failure:
                    if not keep_failed:
                        raise
                    values, error = [None] * len(part), str(failure) or type(failure).__name__
                part[names[0]] = pd.Series(values, index=part.index, dtype=object)
                if len(names) > 1:
                    part[names[1]] = error
                yield part

    return df.mapInPandas(apply, schema)


def score_pairs(pairs: DataFrame, factory: Callable, batch: int = 16) -> DataFrame:
    """Add ``score`` to ``pairs(query_id, item_id, query, text)``; a batch that fails has none, so the
    rerank operators keep its order."""
    scored = _run(pairs, ["query", "text"], factory, batch, [("score", T.DoubleType()), ("score_error", T.StringType())], True)
    return scored.select("query_id", "item_id", "score", "score_error")


def embed(rows: DataFrame, factory: Callable, text: str = "text", batch: int = 32) -> DataFrame:
    """Add ``embedding``; a failing model fails the job, as an index must not lack rows."""
    return _run(rows, [text], factory, batch, [("embedding", T.ArrayType(T.FloatType()))], False)


def judge(samples: DataFrame, factory: Callable, batch: int = 8) -> DataFrame:
    """Add ``scores`` (metric → value) to ``samples(question, retrieved_contexts, answer, reference)``; an
    exception marks every sample of its batch in ``judge_failure``."""
    columns = ["question", "retrieved_contexts", "answer", "reference"]
    scores = T.MapType(T.StringType(), T.StringType())
    return _run(samples, columns, factory, batch, [("scores", scores), ("judge_failure", T.StringType())], True)

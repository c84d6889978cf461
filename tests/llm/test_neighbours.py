import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.neighbours import Index, Lists, balanced_centroids, fit, neighbours

SCHEMA = "vec_id long, embedding array<float>, list int, score string"


def plain(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            by = {}
            for j, w in good:
                if j != i:
                    s = float((v * w).sum() / (np.linalg.norm(v) * np.linalg.norm(w)))
                    by[j] = max(s, by.get(j, -2))
            out[i] = sorted(by.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def found(spark, rows, k=5, cfg=None):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(5)
    out = {}
    for r in neighbours(df, F.col("vec_id") % 50 == 0, k, cfg).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def vectors(n, dim=16, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()


def test_recall_and_scores(spark):
    rows = list(enumerate(vectors(4000)))
    got, want = found(spark, rows), plain(rows, 5)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    all_scores = {q: dict(plain([(q, dict(rows)[q]), *[r for r in rows if r[0] in {v for v, _ in got[q]}]], 5)[q]) for q in list(want)[:10]}
    for q, scores in all_scores.items():
        assert all(abs(s - scores[v]) < 1e-12 for v, s in got[q])


@pytest.mark.parametrize("block", [7, 8192])
def test_few_rows_ties_and_bad_vectors(spark, block):
    same = [1.0, 2.0, 0.0, 0.0]
    rows = [(0, same), (50, same), *[(i, same) for i in range(1, 30)], (100, [0.0, 0.0, 1.0, 0.0]), (31, None), (32, [0.0] * 4), (33, [1.0, None, 0.0, 0.0]),
            (34, [float("nan"), 1.0, 0.0, 0.0]), (35, [float("inf"), 1.0, 0.0, 0.0]), (None, same), (150, [0.0] * 4), (36, [1.0, 2.0]), (3, same), (0, same)]
    got = found(spark, rows, cfg=Lists(block=block))
    want = plain([r for r in rows if r[1] is None or len(r[1]) == 4], 5)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_fewer_than_k_others(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])]
    assert [v for v, _ in found(spark, rows)[0]] == [1, 2]
    assert found(spark, rows[:1]) == {}
    assert found(spark, []) == {}


def test_walk_finds_what_a_full_look_finds():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = fit(points, 3000, Lists(per_list=10), 5)
    assert isinstance(index, Index) and len(index.centroids) >= 128
    walked = index.search(points[:200], 1.0, 16).argmin(axis=1)
    assert (walked == (points[:200] @ index.centroids.T).argmax(axis=1)).mean() > 0.95


def test_lists_are_balanced():
    points = np.random.default_rng(3).normal(size=(1024, 8)).astype(np.float32)
    assert len(balanced_centroids(points, 64, 1)) == 64
    assert len(balanced_centroids(np.ones((100, 4), np.float32), 8, 1)) == 1

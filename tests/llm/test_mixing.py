import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.mixing import Mix, mixed


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        above = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "zz", "tiny", "blank", "A"]
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 20, 60, 400])), rng.choice(names[:5]), 9, rng.random()) for i in range(n)]
    rows += [(n, "one two", "tiny", 9, 1.0), (n + 1, " ", "blank", 9, 1.0), (n + 2, None, "blank", 9, 1.0), (None, "some words here", "A", 9, 1.0), (n + 3, "w " * 40_000, "a", 9, 1.0)]
    rows += [(5, "again and again", "b", 9, 0.5)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, importance double").repartition(6)


@pytest.mark.parametrize("weight", [None, "importance"])
def test_targets_and_taken_words(spark, weight):
    docs = corpus(spark)
    rows = mixed(docs, weight=weight).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and rows[0].source_size
        assert abs(taken[s] - want[s]) <= max(60, 0.01 * want[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixed(docs.repartition(3), weight=weight).collect()))


def test_pareto_sample_follows_its_inclusion_weights(spark):
    """Each document is drawn about as often as its weight says, over many seeds."""
    docs = spark.createDataFrame([(i, "one two three four", "s", 1.0 + i % 3) for i in range(900)], "doc_id long, text string, source string, w double")
    counts = {0: 0, 1: 0, 2: 0}
    for seed in range(2):
        out = mixed(docs, Mix(weights=(1.0,), share=0.4, seed=seed), weight="w")
        rows = out.groupBy((F.col("doc_id") % 3).alias("k")).agg(F.sum("copies").alias("n")).collect()
        assert sum(r.n for r in rows) == 360
        for r in rows:
            counts[r.k] += r.n
    assert counts[0] / 600 == pytest.approx(0.2, abs=0.06)
    assert counts[1] / 600 == pytest.approx(0.4, abs=0.07)
    assert counts[2] / 600 == pytest.approx(0.6, abs=0.07)


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixed(empty).count() == 0
    rows = mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_main_path(spark):
    plan = mixed(corpus(spark, 50))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_callers_private_names_pass(spark):
    docs = corpus(spark, 300)
    wide = docs.selectExpr("*", "7 AS _rate", "'x' AS _source", "doc_id AS _order", "1 AS _row", "'y' AS `a.b`", "2 AS copies", "3 AS target")
    out = mixed(wide)
    assert out.columns == ["doc_id", "text", "source", "importance", "_rate", "_source", "_order", "_row", "a.b", "size", "source_size", "target", "copies"]
    rows = out.collect()
    assert all((r._rate, r._source, r._order, r._row, r["a.b"]) == (7, "x", r.doc_id, 1, "y") for r in rows)
    assert sorted(map(str, [(r.doc_id, r.size, r.copies) for r in rows])) == sorted(map(str, [(r.doc_id, r.size, r.copies) for r in mixed(docs).collect()]))


def test_very_many_sources_are_salted(spark, monkeypatch):
    docs = corpus(spark, 400)
    want = sorted(map(str, mixed(docs).collect()))
    monkeypatch.setattr(mixing.plan_mix, "__defaults__", (0,))
    assert sorted(map(str, mixed(docs).collect())) == want

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives
from lodestone.llm.negatives import Mining, hard_negatives, primes_for, reconstruct, residues, scores

KINDS = "vec_id long, embedding array<double>, label int"


def plain(rows, cfg, every):
    usable = [(i, [math.floor(cfg.scale * x) for x in v], y) for i, v, y in rows
              if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for a, va, ya in sorted(usable, key=lambda r: (r[0], r[2], r[1])):
        if a % every or a in done:
            continue
        done.add(a)
        scored = sorted(((-sum(x * z for x, z in zip(va, v)), i, y) for i, v, y in usable if i != a))
        best = [(i, -s) for s, i, y in scored if y == ya][:cfg.positives]
        for p, ps in best:
            fits = [(i, -s) for s, i, y in scored if y != ya and cfg.low * ps <= -100 * s <= cfg.high * ps][:cfg.negatives]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(fits)]
    return sorted(out)


def mined(df, every, cfg=None):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0, cfg).collect())


def table(n, width, labels, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [spread * (c + rng.gauss(0, 1)) for c in centres[i % labels]], (i * 7 // 3) % labels) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(3, 0.05), (8, 1.0), (300, 40.0)])
def test_against_plain_search(spark, width, spread):
    rows, cfg = table(260, width, 3, width, spread), Mining(cells=900, sample=3)
    assert mined(spark.createDataFrame(rows, KINDS).repartition(3), 20, cfg) == plain(rows, cfg, 20)


def test_blocks_of_anchors(spark):
    rows, cfg = table(150, 4, 2, 5), Mining(block_bytes=3 * 32)
    assert mined(spark.createDataFrame(rows, KINDS), 10, cfg) == plain(rows, cfg, 10)


def test_ties_repeats_and_unusable_rows(spark):
    rows = table(60, 4, 2, 9, 0.02) + [(100, [1.0, 0, 0, 0], 0), (100, [1.0, 0, 0, 0], 0), (100, [2.0, 0, 0, 0], 1), (101, [0.5, 0, 0, 0], 1), (101, [0.5, 0, 0, 0], 1), (102, [0.5], 1), (103, [], 0),
                                       (104, None, 1), (110, [1.0, None, 0, 0], 0), (120, [math.nan, 0, 0, 0], 0), (130, [math.inf, 0, 0, 0], 1), (140, [1.0, 1, 1, 1], None), (None, [1.0, 0, 0, 0], 0)]
    rows += [(200 + i, [0.9, 0, 0, 0], 0) for i in range(8)] + [(300 + i, [0.3, 0, 0, 0], 1) for i in range(30)]
    rows = [(i, v and [x if x is None else float(x) for x in v], y) for i, v, y in rows]
    df = spark.createDataFrame(rows, KINDS).withColumn("score", F.lit("x")).withColumn("anchor_id", F.lit(1))
    assert mined(df, 10) == plain(rows, Mining(), 10)


def test_empty_and_one_label(spark):
    df = spark.createDataFrame(table(20, 2, 1, 1), KINDS)
    assert mined(df, 5) == mined(df.limit(0), 5) == mined(df, 1000003) != [()]


def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for width, size in ((1, 2**29), (64, 300), (5000, 2**20), (700, 1)):
        a, b = (np.floor(rng.uniform(-size, size, (5, width))) for _ in range(2))
        bound = max(int(sum(int(x) ** 2 for x in row)) for row in (*a, *b))
        primes = primes_for(bound)
        assert math.prod(primes) > 2 * bound and all(len([d for d in range(1, p + 1) if p % d == 0]) == 2 for p in primes)
        found = scores([residues(a, p) for p in primes], [residues(b, p) for p in primes], primes)
        assert found.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_chinese_remainders_at_the_ends():
    bound = 2**60
    primes = primes_for(bound)
    values = np.array([0, 1, -1, bound, -bound, bound - 1, 12345678901234567], np.int64)
    assert (reconstruct([negatives._centred(values, p) for p in primes], primes) == values).all()

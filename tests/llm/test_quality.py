import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.quality import STATISTICS, Condition, RuleEnsemble, statistics_of


def corpus(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    clean = lambda: ". ".join(" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(9)) for _ in range(rng.randrange(2, 20)))
    junk = lambda: " ".join([rng.choice(words).upper() + rng.choice(["!!", "$$$", "%%%"])] * rng.randrange(20, 90))
    rows = [(i, junk() if i % 3 == 0 else clean(), 0 if i % 3 == 0 else 1) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(None, "no id here", "x", 1.0), (401, None, "x", 1.0), (402, "", "x", 1.0), (0, rows[0][1], "x", 1.0)], "doc_id long, text string, _stats string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (9999, 0), (5, 7)], "doc_id long, quality int")
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    ensemble = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    assert ensemble.weights and all(c.statistic in STATISTICS for rule, _ in ensemble.weights for c in rule)
    out = quality.scored(docs, ensemble, name="score")
    assert out.columns == ["doc_id", "text", "_stats", "score"] and out.count() == 404 and out.where("_stats = 'x'").count() == 404
    rows = out.join(labels.where("quality in (0, 1)"), "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 40 and all(0 <= r.score <= 1 for r in rows)
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert out.where("score is null").count() == 0


@pytest.mark.parametrize("keep,score", [("quality = 1", 0.99), ("quality = 0", 0.01), ("false", 0.5)])
def test_one_label_or_none(spark, keep, score):
    docs, labels = corpus(spark)
    ensemble = quality.fit(docs, labels.where(keep))
    assert not ensemble.weights
    assert quality.scored(docs, ensemble).first().score == pytest.approx(score, abs=0.02)
    assert quality.scored(docs.limit(0), ensemble).count() == 0


def test_rules_become_columns(spark):
    rule = (Condition("log_words", True, 1.0), Condition("digits", False, 0.1))
    docs = spark.createDataFrame([("a b c d",), ("a",), ("1 2 3 4",)], "text string")
    scores = [r.score for r in quality.scored(docs, RuleEnsemble(0.0, ((rule, 2.0),))).collect()]
    assert scores == pytest.approx([0.8808, 0.5, 0.5], abs=1e-4)


def test_statistics_of_edge_texts():
    assert statistics_of(b"") == statistics_of(b" \n\t") == [0.0] * len(STATISTICS)
    s = dict(zip(STATISTICS, statistics_of("Äb 12 !! a a.\na a.".encode()), strict=True))
    assert s["upper"] == pytest.approx(1 / 6) and s["digits"] == pytest.approx(2 / 18) and s["repeated_words"] == 0.0
    assert s["distinct_lines"] == 1.0 and s["sentence_ends"] == pytest.approx(3 / 7) and s["doubled_marks"] == pytest.approx(1 / 7)


def plain_score(ensemble, text):
    """The ensemble by hand, rule by rule."""
    stats, odds = dict(zip(STATISTICS, statistics_of(text.encode()), strict=True)), ensemble.intercept
    for rule, weight in ensemble.weights:
        odds += weight * all((stats[c.statistic] > c.bound) == c.above for c in rule)
    return 1 / (1 + math.exp(-odds))


def test_columns_equal_the_rules_by_hand(spark):
    docs, labels = corpus(spark)
    ensemble = quality.fit(docs, labels)
    out = quality.scored(docs.union(spark.createDataFrame([(7, "w " * 300_000, "x", 1.0)], docs.schema)), ensemble).collect()
    assert len(out) == 405 and all(r.score == pytest.approx(plain_score(ensemble, r.text or ""), abs=1e-12) for r in out)


def test_contradicting_labels_even_out(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)], "doc_id long, quality int")
    ensemble = quality.fit(docs, labels)
    assert {round(r.score, 6) for r in quality.scored(docs, ensemble).collect()} == {0.5}

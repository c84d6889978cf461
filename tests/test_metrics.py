"""Hand-computed metric values."""

from math import log2

import pytest

from lodestone.operators import judging, metrics, summaries


def frames(spark):
    questions = spark.createDataFrame([("q1", "a", 10.0), ("q2", "", 20.0), ("q3", "b", 30.0)], "question_id string, question_type string, latency_ms double")
    ranked = spark.createDataFrame(
        [("q1", "x", 1), ("q1", "", 2), ("q1", "g1", 3), ("q1", "g1", 4), ("q1", "g2", 5), ("q2", "y", 1)], "question_id string, item_id string, rank int")
    gold = spark.createDataFrame([("q1", "g1"), ("q1", "g2"), ("q1", "g3"), ("q1", "g1"), ("q3", "z")], "question_id string, item_id string")
    return questions, ranked, gold


def test_question_metrics(spark):
    rows = {(r.question_id, r.k): r for r in metrics.question_metrics(*frames(spark), [1, 2, 4]).collect()}
    assert len(rows) == 9
    one = rows["q1", 4]
    # the blank closes up: x, g1, g1, g2
    assert (one.hit, one.precision, one.recall) == (1, 0.5, pytest.approx(2 / 3))
    assert one.f1 == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3))
    assert one.rr == 0.5 and one.ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert one.ndcg == pytest.approx((1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3) + 1 / log2(4)))
    assert (rows["q1", 1].hit, rows["q1", 1].rr) == (0, 0.0)
    for key in (("q2", 4), ("q3", 4)):
        assert (rows[key].hit, rows[key].recall, rows[key].ap, rows[key].ndcg) == (0, 0.0, 0.0, 0.0)


def test_bad_k(spark):
    with pytest.raises(ValueError):
        metrics.question_metrics(*frames(spark), [0, 5])


def test_coverage(spark):
    questions, _, _ = frames(spark)
    evidence = spark.createDataFrame([("q1", 1, ["a", ""]), ("q1", 2, ["b", "c"])], "question_id string, rank int, evidence_ids array<string>")
    groups = spark.createDataFrame([("q1", "g", "a"), ("q1", "h", "c"), ("q1", "h", "z"), ("q1", "i", "w")], "question_id string, group_id string, evidence_id string")
    rows = {(r.question_id, r.k): r.evidence_coverage for r in metrics.evidence_coverage_at_k(questions, evidence, groups, [1, 2]).collect()}
    assert rows["q1", 1] == pytest.approx(1 / 3) and rows["q1", 2] == pytest.approx(2 / 3) and rows["q2", 2] == 0.0


def test_summaries(spark):
    questions, ranked, gold = frames(spark)
    found = metrics.question_metrics(questions, ranked, gold, [1, 4])
    summary = {(r.metric, r.k): r.value for r in summaries.summarize_run(questions, found, [1, 4]).collect()}
    assert summary["hit", 4] == 0.3333 and summary["questions", 0] == 3 and summary["average_latency_ms", 0] == 20.0
    assert ("mrr", 4) in summary and ("mrr", 1) not in summary
    groups = {(r.group, r.metric, r.k): r.value for r in summaries.group_summary(questions, found, "question_type", [1, 4]).collect()}
    assert groups["unknown", "questions", 0] == 1 and groups["a", "hit", 4] == 1.0
    evidence = {(r.metric, r.k): r.value for r in summaries.evidence_only_summary(questions, found, [1, 4]).collect()}
    assert evidence["hit", 4] == 0.5 and evidence["excluded_questions_without_expected_docs", 0] == 1
    assert [tuple(r) for r in summaries.non_retrieval_summary(questions, gold).collect()] == [("unknown", 1)]


def test_empty_run(spark):
    questions, ranked, gold = (df.limit(0) for df in frames(spark))
    found = metrics.question_metrics(questions, ranked, gold, [5])
    assert found.count() == 0
    assert {r.metric: r.value for r in summaries.summarize_run(questions, found, [5]).collect()}["questions"] == 0


def test_winner_rejects_mixed_mrr(spark):
    schema = "run_order int, run_id string, recall_10 double, coverage_10 double, hit_5 double, mrr double, mrr_k int, ndcg_10 double"
    rows = [(1, "a", 0.9, 0.0, 0.5, 0.4, 20, 0.3), (2, "b", 0.9, 0.0, 0.5, 0.4, 20, 0.3), (3, "c", 0.8, 1.0, 1.0, 1.0, 20, 1.0)]
    assert summaries.select_winner(spark.createDataFrame(rows, schema)).first().run_id == "a"
    with pytest.raises(Exception, match="different k"):
        summaries.select_winner(spark.createDataFrame([*rows, (4, "d", 0.1, 0.0, 0.0, 0.0, 10, 0.0)], schema)).collect()


def test_judge(spark):
    records = spark.createDataFrame([("a", None, 1.0), ("b", "boom", 2.0), ("c", None, 3.0), ("d", None, 4.0)], "question_id string, generation_error string, latency_ms double")
    full = {m: "0.5" for m in judging.model.JUDGE_METRICS}
    scores = spark.createDataFrame([("a", full), ("c", {"faithfulness": "x"})], "question_id string, scores map<string,string>")
    attached = judging.attach_judge_scores(records, scores)
    errors = {r.question_id: r.judge_error for r in attached.collect()}
    assert errors == {"a": None, "b": None, "c": "RAGAS returned no numeric scores", "d": "RAGAS returned fewer results than samples"}
    row = judging.judge_summary(attached, 4).filter("metric = 'faithfulness'").first()
    assert (row.valid, row.failures, row.status, row.value, row.coverage_rate) == (1, 3, "incomplete", 0.5, 0.25)


def test_gate_fails_on_missing_metric(spark):
    summary = spark.createDataFrame([("hit", 5, 0.8)], "metric string, k int, value double")
    limits = spark.createDataFrame([("hit", 5, 0.7, None), ("hit", 10, 0.1, None)], "metric string, k int, at_least double, at_most double")
    assert {r.k: r.passed for r in summaries.regression_gate(summary, limits).collect()} == {5: True, 10: False}

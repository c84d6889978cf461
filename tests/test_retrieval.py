"""Search against plain Python, fusion rules, hooks, fallback."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, filters, fusion, graph, hooks, lexical, memories, postings, rerank
from lodestone.plans import retrieve as plan

TEXTS = {"a": "Red apple pie", "b": "apple apple tart", "c": "", "d": "blue sky", "e": "apple apple tart", "f": None}


def items(spark):
    return spark.createDataFrame(list(TEXTS.items()), "item_id string, text string")


def test_bm25_by_hand(spark):
    questions = spark.createDataFrame([("q", "APPLE apple tart"), ("none", "zebra"), ("blank", None)], "query_id string, query string")
    docs = {k: re.findall(r"[a-z]+", (v or "").lower()) for k, v in TEXTS.items()}
    avgdl = sum(map(len, docs.values())) / len(docs)
    want = {}
    for term, qf in Counter(["apple", "apple", "tart"]).items():
        df = sum(term in d for d in docs.values())
        for key, d in docs.items():
            tf = d.count(term)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                want[key] = want.get(key, 0) + qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
    got = lexical.bm25_search_children(questions, items(spark), 10).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["b", "e", "a"]
    for row in got:
        assert row.score == pytest.approx(want[row.item_id], abs=1e-8)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_ids_keep_their_type_and_order(spark, monkeypatch, limit):
    """On either side of the broadcast bound, ties of whole numbers go by number."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", limit)
    rows = spark.createDataFrame([(i, "same words") for i in (10, 9, 100, 2)], "item_id long, text string").repartition(2)
    asked = spark.createDataFrame([(7, "words")], "query_id long, query string")
    got = lexical.bm25_search_children(asked, rows, 3)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:2] == [("query_id", "bigint"), ("item_id", "bigint")]
    assert [(r.query_id, r.item_id) for r in got.orderBy("rank").collect()] == [(7, 2), (7, 9), (7, 10)]


def corpus_of_words(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["common"] * int(rng.integers(1, 4)) + [f"w{int(rng.zipf(1.6)) % 300}" for _ in range(int(rng.integers(1, 40)))])) for i in range(n)]
    rows += [(n + i, "common rare gem" if i % 2 else "rare") for i in range(12)] + [(n + 20, None), (n + 21, "")]
    asked = [("a", "common rare"), ("b", "w1 w2 w250"), ("c", "gem gem common"), ("d", "absent"), ("e", None), ("f", "common")]
    return spark.createDataFrame(rows, "item_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id string, query string")


@pytest.mark.parametrize("segment,k", [(4, 3), (16, 10), (128, 700)])
def test_blocks_give_the_rows_of_a_full_search(spark, tmp_path, segment, k):
    rows, asked = corpus_of_words(spark)
    index = lexical.bm25_index(rows)
    blocks = postings.save_blocks(index, str(tmp_path), segment, 16)
    plain = lambda df: sorted((r.query_id, r["rank"], r.item_id, r.score) for r in df.collect())
    assert plain(postings.search_blocks(asked, blocks, k)) == plain(lexical.bm25_search(asked, None, k, index=index))


def test_only_asked_folders_and_hopeful_blocks_are_read(spark, tmp_path):
    rows, asked = corpus_of_words(spark)
    blocks = postings.save_blocks(lexical.bm25_index(rows), str(tmp_path), 8, 16)
    terms = lexical.query_terms(asked.where("query_id = 'a'"))
    folders = lambda df: {re.search(r"bucket=(\d+)", r.f)[1] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 0 < len(folders(postings.asked_blocks(blocks, terms))) <= 2 < len(folders(blocks.blocks))
    every = blocks.blocks.where("term = 'common'").count()
    opened = postings.open_blocks(terms, blocks, 3).where("term = 'common'").count()
    assert 0 < opened < 0.5 * every
    assert max(r.n for r in blocks.blocks.groupBy("term", "segment").agg(F.count("*").alias("n")).collect()) == 1


@pytest.mark.parametrize("segment,batch", [(4, 7), (64, 10_000)])
def test_opened_blocks_are_scored_where_their_segment_lies(spark, tmp_path, monkeypatch, segment, batch):
    rows, asked = corpus_of_words(spark, 200)
    blocks = postings.save_blocks(lexical.bm25_index(rows), str(tmp_path), segment, 8)
    plain = lambda df: sorted((r.query_id, r["rank"], r.item_id, r.score) for r in df.collect())
    monkeypatch.setattr(postings, "SCORE_CELLS", 30)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        found = postings.search_blocks(asked, blocks, 5)
        # no scored pair of an item and a question is shuffled
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        scanned = plain(found)
    finally:
        spark.conf.set(size, before)
    monkeypatch.setattr(postings, "BROADCAST_TERMS", 0)
    assert scanned == plain(postings.search_blocks(asked, blocks, 5)) and len(scanned) == 20


def test_index_round_trip(spark, tmp_path):
    index = lexical.bm25_index(items(spark), "parent")
    index.save(str(tmp_path))
    loaded = lexical.LexicalIndex.load(spark, str(tmp_path))
    assert loaded.stats.first().n_docs == 4
    assert sorted(map(tuple, loaded.postings.collect())) == sorted(map(tuple, index.postings.collect()))


def vectors(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((n, 16))
    matrix[5] = 0
    matrix[9] = matrix[8]
    rows = [(f"v{i:03d}", [float(x) for x in row], ["slack", "jira"][i % 2]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "item_id string, embedding array<double>, source_type string").repartition(5), matrix


def nearest(matrix, q, k, keep=lambda i: True):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    length = np.linalg.norm(q)
    scores = np.round(unit @ (q / length), 9) if length else np.zeros(len(matrix))
    return [f"v{i:03d}" for i in sorted((i for i in range(len(matrix)) if keep(i)), key=lambda i: (-scores[i], i))][:k]


def test_knn_exact_approx_and_filters(spark, monkeypatch):
    monkeypatch.setattr(dense, "BYTES_PER_PACK", 16 * 8 * 20)
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", 7)
    rows, matrix = vectors(spark)
    queries = rows.select(F.col("item_id").alias("query_id"), "embedding")
    exact = dense.knn_exact(queries, rows, 5).cache()
    found = {}
    for r in exact.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.item_id)
    for i in range(len(matrix)):
        assert found[f"v{i:03d}"] == nearest(matrix, matrix[i], 5), i
    approximate = dense.knn_approx(queries, rows, 5)
    assert dense.recall(approximate, exact).first().recall >= 0.9
    assert dense.knn_exact(queries, rows, 0).count() == 0
    rules = queries.select("query_id", F.lit("hard").alias("mode"), F.array(F.lit("jira")).alias("source_types"),
                           *[F.array().cast("array<string>").alias(c) for c in ("doc_semantic_types", "title_keywords", "section_keywords")])
    attributed = filters.dense_attributes(rows.withColumn("doc_semantic_type", F.lit("faq")).withColumn("title", F.lit("")).withColumn("section_heading", F.lit("")))
    only = dense.knn_exact(filters.dense_filters(queries.filter("query_id = 'v000'"), rules), attributed, 5).orderBy("rank").collect()
    assert [r.item_id for r in only] == nearest(matrix, matrix[0], 5, lambda i: i % 2 == 1)


def test_semantic_duplicates_keep_the_first(spark):
    schema = "id string, user_id string, ordinal int, embedding array<double>, status string"
    batch = spark.createDataFrame([("1", "u", 1, [1.0, 0.0], None), ("2", "u", 2, [1.0, 0.01], None), ("3", "w", 3, [1.0, 0.0], None), ("4", "u", 4, [0.0, 1.0], None)], schema)
    store = spark.createDataFrame([("s", "u", 0, [0.0, 1.0], "active"), ("t", "w", 0, [1.0, 0.0], "deleted")], schema)
    assert sorted(r.id for r in memories.drop_semantic_duplicates(batch, store).collect()) == ["1", "3"]


def ranked(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, item_id string, rank int, score double")


def test_rrf_repeats_and_blanks(spark):
    first = ranked(spark, [("a", 1, 1.0), ("a", 2, 0.9), ("b", 3, 0.8), ("", 4, 0.1)])
    second = ranked(spark, [("b", 1, 1.0)])
    rows = {r.item_id: r.score for r in fusion.rrf_fuse({"x": first, "y": second}).collect()}
    assert rows == {"a": round(1 / 61, 9), "b": round(1 / 63 + 1 / 61, 9)}


def test_unions_meet_under_adaptive_execution(spark):
    """Both lists are partitioned by query before they are stacked; equal keys must still meet."""
    wide = spark.range(4000).select(F.col("id").cast("string").alias("query_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("item_id"), F.rand(1).alias("score"))
    from lodestone.operators.ranking import keep_top

    small, large = keep_top(wide.filter("query_id < '2'"), 2), keep_top(wide, 2)
    for _ in range(3):
        assert fusion.rrf_fuse({"x": small, "y": large}).groupBy("query_id", "item_id").count().filter("count > 1").count() == 0


def test_soft_boost_is_never_double(spark):
    fused = spark.createDataFrame([("q", "a", 1.0, "slack", "faq", "The Plan", "")], "query_id string, item_id string, score double, source_type string, doc_semantic_type string, title string, section_heading string")
    rules = spark.createDataFrame([("q", "soft", ["slack"], ["faq"], ["plan"], [], ["slack"])],
                                  "query_id string, mode string, source_types array<string>, doc_semantic_types array<string>, title_keywords array<string>, section_keywords array<string>, source_hints array<string>")
    assert filters.soft_boost(fused, rules).first().score == 1.15
    assert filters.soft_boost(fused, rules.withColumn("mode", F.lit("hard")).withColumn("source_hints", F.array(F.lit("jira")))).first().score == 1.0


def test_rerank_failure_keeps_order(spark):
    pairs = spark.createDataFrame([("q", i, "ask", t) for i, t in (("a", "x"), ("b", "xx"), ("c", "boom"))], "query_id string, item_id string, query string, text string")

    def factory():
        def score(queries, texts):
            if "boom" in texts:
                raise RuntimeError("no model")
            return [float(len(t)) for t in texts]

        return score

    scores = hooks.score_pairs(pairs.repartition(1), factory, batch=2)
    assert {r.item_id: (r.score, r.score_error) for r in scores.collect()} == {"a": (1.0, None), "b": (2.0, None), "c": (None, "no model")}
    order = rerank.rerank_all(ranked(spark, [("c", 1, 0.0), ("a", 2, 0.0), ("b", 3, 0.0)]), scores)
    assert [r.item_id for r in order.orderBy("rank").collect()] == ["b", "a"]
    failed = hooks.score_pairs(pairs.repartition(1), factory, batch=9)
    kept = rerank.rerank_all(ranked(spark, [("c", 1, 0.0), ("a", 2, 0.0)]), failed)
    assert [r.item_id for r in kept.orderBy("rank").collect()] == ["c", "a"]


def test_fallback_passes(spark):
    questions = spark.createDataFrame([("ok", "x", ["s"]), ("soft", "x", ["s"]), ("word", "x", None), ("never", "x", None)], "query_id string, query string, source_hints array<string>")
    rules = spark.createDataFrame([("ok", "hard", "r"), ("soft", "hard", "r"), ("word", "hard", "r"), ("never", "none", "r")], "query_id string, mode string, reason string")

    def search(asked, given):
        joined = asked.join(given.select("query_id", "mode"), "query_id")
        hit = (F.col("query_id") == "ok") | ((F.col("query_id") == "soft") & (F.col("mode") == "soft")) | ((F.col("query_id") == "word") & F.col("query").endswith("evidence"))
        return joined.filter(hit).select("query_id", F.lit("d").alias("item_id"), F.lit(1).alias("rank"))

    rows = {r.query_id: r.attempt for r in plan.retrieve_with_fallback(questions, rules, search).collect()}
    assert rows == {"ok": 1, "soft": 2, "word": 3}


def passes(spark, max_retries=1, **evidence):
    questions = spark.createDataFrame([(q, "x", ["s"]) for q in ("full", "half", "later")], "query_id string, query string, source_hints array<string>")
    rules = spark.createDataFrame([("half", "soft", "r")], "query_id string, mode string, reason string")
    subs = spark.createDataFrame([(q, s) for q in ("full", "half", "later") for s in ("sq1", "sq2")], "query_id string, sub_query_id string")

    def search(asked, given):
        both = (F.col("query_id") == "full") | ((F.col("query_id") == "later") & F.col("query").endswith("evidence"))
        met = F.when(both, F.array(F.lit("sq1"), F.lit("sq2"))).otherwise(F.array(F.lit("sq1")))
        return asked.select("query_id", F.col("query").alias("item_id"), F.lit(1).alias("rank"), met.alias("matched_sub_query_ids"),
                            F.lit("o").alias("owner_user_id"), F.lit("k").alias("knowledge_base_id"), F.lit("private").alias("visibility"))

    return plan.evidence_passes(questions, rules, search, max_retries, subs, **evidence)


def test_partly_covered_questions_go_on(spark):
    found = passes(spark)
    states = {r.query_id: (r.attempt, r.retry_count, r.context_score, r.next_action) for r in found.states.collect()}
    assert states == {"full": (1, 0, 1.0, "generate"), "later": (2, 1, 1.0, "generate"), "half": (2, 1, 0.5, "external_search")}
    # the last pass counts, though the first had found something
    assert {(r.query_id, r.item_id) for r in found.selected.collect()} == {
        ("full", "x"), ("later", "x s enterprise knowledge evidence"), ("half", "x s enterprise knowledge evidence")}


@pytest.mark.parametrize("retries", [0, 2])
def test_retry_budget(spark, retries):
    states = {r.query_id: (r.attempt, r.next_action) for r in passes(spark, retries).states.collect()}
    later = (1, "external_search") if retries == 0 else (2, "generate")
    assert states == {"full": (1, "generate"), "later": later, "half": (1 + retries, "external_search")}


def test_guards_stop_at_once(spark):
    users = spark.createDataFrame([("full", "o"), ("half", "other"), ("later", "o")], "query_id string, user_id string")
    grants = spark.createDataFrame([], "user_id string, knowledge_base_id string")
    guarded = spark.createDataFrame([("later",)], "query_id string")
    found = passes(spark, acl=(users, grants), guarded=guarded)
    states = {r.query_id: (r.attempt, r.n_documents, r.next_action) for r in found.states.collect()}
    assert states == {"full": (1, 1, "generate"), "half": (1, 0, "insufficient_evidence"), "later": (1, 1, "insufficient_evidence")}
    assert {r.query_id for r in found.selected.collect()} == {"full", "later"}


def test_graph_hits_leave_their_ids_as_evidence(spark):
    """A parent that the graph finds raises its child, enters alone without one, and is reranked by its own text."""
    names = "item_id string, text string, parent_chunk_id string, parent_doc_id string, source_type string, doc_semantic_type string, title string, section_heading string"
    children = spark.createDataFrame([("a", "valve notes", "P1", "D1", "wiki", "", "t", ""), ("b", "valve list valve", "P2", "D2", "wiki", "", "t", "")], names)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "item_id string, embedding array<double>")
    parents = spark.createDataFrame([("P1", "D1", "wiki", "guide", "pump", "", "x"), ("P3", "D3", "wiki", "guide", "pump", "", "long text of a parent")],
                                    "parent_chunk_id string, parent_doc_id string, source_type string, doc_semantic_type string, title string, section_heading string, text string")
    asked = spark.createDataFrame([("q", "pump valve", "semantic", None, None)], "query_id string, query string, question_type string, source_types array<string>, answer_facts array<string>")
    models = plan.Models(lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")),
                         lambda pairs: pairs.select("query_id", "item_id", F.length("text").cast("double").alias("score")))
    corpus = plan.Corpus(children, vectors, graph.build_graph(parents))
    found = plan.retrieve("chroma_bm25_graph_rrf_reranker", asked, corpus, models, 5, 5)
    rows = {r.item_id: (r.evidence_ids, r.doc_semantic_type) for r in found.candidates.collect()}
    assert rows == {"a": (["a", "P1"], "guide"), "b": (["b"], "generic_doc"), "P3": (["P3"], "guide")}
    assert [r.item_id for r in found.documents.orderBy("rank").collect()] == ["P3", "b", "a"]
    assert [(r.item_id, r.evidence_ids) for r in found.coverage.orderBy("rank").collect()] == [("P3", ["P3"]), ("b", ["b"]), ("a", ["a", "P1"])]
    with pytest.raises(ValueError):
        plan.retrieve("strategy_matrix_graph", asked, plan.Corpus(children, vectors), models)


def test_unknown_method():
    assert plan.method_row("hybrid_bm25_rrf")[0] == "chroma_bm25_rrf"
    with pytest.raises(ValueError):
        plan.method_row("nope")

def test_corpora_searched_one_by_one_give_the_rows_of_joined_postings(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{n:02d}", f"a{n % 3} b{n % 5} word word{n % 2}", "xy"[n % 2]) for n in range(40)], "item_id string, text string, part string")
    asked = spark.createDataFrame([("q1", "word a1 b2"), ("q2", "word0 b4"), ("q3", "none")], "query_id string, query string")

    def rows():
        return sorted(map(str, lexical.bm25_search(asked, items, 7, by=("part",)).select("part", "query_id", "item_id", "score", "rank").collect()))

    one_by_one = rows()
    with monkeypatch.context() as patched:
        # no scored pair of an item and a question is shuffled
        patched.setattr(lexical, "bm25_scores", None)
        assert one_by_one == rows()
    monkeypatch.setattr(lexical, "MAX_CORPORA", 0)
    assert one_by_one == rows() and len(one_by_one) == 25


def test_multifield_keeps_the_best_of_each_field(spark, monkeypatch):
    rows = spark.createDataFrame([(f"i{n:02d}", f"a{n % 3} word b{n % 7}", f"t{n % 4} word", "fr" if n % 2 else "") for n in range(40)],
                                 "item_id string, child_text string, title string, lang string")
    asked = spark.createDataFrame([("q1", "word a1 t2"), ("q2", "fr"), ("q3", "b3 t1")], "query_id string, query string")

    def found():
        return sorted(map(str, lexical.bm25_multifield(asked, rows, 9, {"child_text": 0.3, "title": 2.0}, ["lang"]).collect()))

    best = found()
    with monkeypatch.context() as patched:
        patched.setattr(lexical, "bm25_scores", None)
        assert best == found()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert best == found() and len(best) == 27


def test_batches_of_long_texts_are_bounded(spark):
    lexical.bm25_index(spark.createDataFrame([("a", "b")], "item_id string, text string"))
    sizes = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"]) for batch in batches), "n long").collect()
    assert max(r.n for r in sizes) < 6 << 20


def test_hard_rules_are_applied_while_items_are_scored(spark, monkeypatch):
    rows = [(f"i{n:02d}" if n else None, f"word a{n % 3} b{n % 5}", f"c{n}", f"d{n}", ["slack", "jira", None][n % 3], ["faq", "None"][n % 2], ["Big Plan", "big-plan two", None][n % 4 % 3],
             ["Intro", ""][n % 2]) for n in range(40)]
    children = spark.createDataFrame(rows, "item_id string, text string, parent_chunk_id string, parent_doc_id string, source_type string, doc_semantic_type string, title string, section_heading string")
    asked = spark.createDataFrame([(f"q{n}", "word a1 b2") for n in range(8)], "query_id string, query string")
    lists = "query_id string, mode string, source_types array<string>, doc_semantic_types array<string>, title_keywords array<string>, section_keywords array<string>"
    rules = spark.createDataFrame([
        ("q0", "hard", ["slack", None, ""], [], None, []), ("q1", "hard", ["None"], [], [], []), ("q2", "soft", ["slack"], [], [], []), ("q3", "hard", [], ["None"], ["Big, plan"], []),
        ("q4", "hard", [], [], [], ["intro"]), ("q5", "hard", None, None, None, None), ("q6", None, ["slack"], [], [], [])], lists)

    def found():
        ranked = plan.lexical_channel(asked, plan.Corpus(children), 6, rules)
        return sorted(map(str, ranked.select("query_id", "item_id", "score", "rank").collect()))

    with monkeypatch.context() as patched:
        # no scored pair of an item and a question is shuffled
        patched.setattr(lexical, "bm25_scores", None)
        scanned = found()
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert scanned == found() and len(scanned) == 7 * 6

import corpus_pipeline
from lodestone.llm.quality import RuleEnsemble

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        rows[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(rows[name]) <= before.count()
    first = rows["quality classifier"]
    assert sum(q == 1 and d not in first for d, q in labels.items()) <= 1 and sum(q == 0 and d in first for d, q in labels.items()) <= 2
    kept = rows["SimHash near-dedup"]
    texts = {}
    for d, t in first.items():
        texts.setdefault(t, []).append(d)
    assert all(sum(d in kept for d in same) <= 1 for same in texts.values()) and len(kept) >= 0.8 * len(texts)
    clean = rows["benchmark decontamination"]
    assert {d for d in kept if d not in clean} == {d for d, t in kept.items() if any(i in t for i in items)}
    assert all("AKIA" not in t for t in rows["secret scans"].values()) and rows["secret scans"].keys() == clean.keys()
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in mix} <= clean.keys() and all(0 < r.taken == r.copies * r.size <= 3 * r.size for r in mix)
    words = {}
    for r in mix:
        words.setdefault(r.source, [r.target, 0])[1] += r.taken
    largest = {}  # a source misses its target by less than the document that would not fit
    for r in docs.collect():
        largest[r.source] = max(largest.get(r.source, 0), len((r.text or "").split()))
    assert words.keys() == largest.keys() and all(abs(target - taken) <= largest[s] for s, (target, taken) in words.items())


def test_nulls_empty_and_repeated_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None, "en", None, 0), (None, long, None, "s", 1), (2, long, "en", "s", 1), (2, long, "en", "s", 1), (3, "", "en", "s", 0), (4, "token=abcdef12345", "en", "s", 17)]
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == ([(2, long), (4, "[secret]")] if part else [])  # what has no word is no part of a mix
    assert isinstance(RuleEnsemble(0.0, ()).intercept, float)


def test_near_duplicates_go_by_row_not_by_id(spark):
    """Rows that share an id, or have none, stay unless their own text has a near-duplicate."""
    long = " ".join(f"word{i}" for i in range(400))
    other = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcd"]
    rows = [(None, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (None, other[0], "en", "s", 1), (None, other[1], "en", "s", 1),
            (7, other[2], "en", "s", 1), (7, other[3], "en", "s", 1), (7, other[3], "de", "s", 1), (2, other[0] + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        got = corpus_pipeline.one_of_each_group(spark, docs.repartition(parts), "").collect()
        assert sorted([(r.doc_id or 0, r.text, r.lang) for r in got]) == sorted(
            [(2, long + " more", "en"), (0, other[1], "en"), (7, other[2], "en"), (7, other[3], "de"), (2, other[0] + " end", "en")])

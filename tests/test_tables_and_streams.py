"""Files, sinks, positions, turns, and streams over several batches."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import memories, sessions
from lodestone.sources import files, sinks, tables
from lodestone.streaming import admission, ingest, latency, turns


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("知识库".encode("gbk"))
    (tmp_path / "c.txt").write_text(" ")
    (tmp_path / "d.txt").write_text("hello")
    (tmp_path / "e.bin").write_text("x")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "g.txt").write_text("y" * 100)
    rows = files.scan_text_files(spark, str(tmp_path), file_cap=50)
    assert sorted(r.text for r in rows.collect() if r.status == "read") == [" ", "hello", "hello", "知识库"]
    assert {r.path[-5:]: r.status for r in rows.collect() if r.status != "read"} == {"f.txt": "not_text", "g.txt": "too_large"}
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "h.txt").write_text("z" * (21 << 20))
    assert [(len(r.text), r.status) for r in files.scan_text_files(spark, str(tmp_path / "big")).collect()] == [(21 << 20, "read")]
    with pytest.raises(Exception, match="larger than"):
        files.scan_text_files(spark, str(tmp_path), file_cap=50, batch_cap=3).collect()
    registry = spark.createDataFrame([], "md5 string")
    new = files.ingest_new_files(rows, registry)
    assert sorted(r.status for r in new.collect()) == ["empty", "loaded", "loaded"]
    assert files.ingest_new_files(rows, files.to_register(new)).select("status").collect()[0].status == "empty"


def test_text_files_of_a_table_are_small(spark, tmp_path, monkeypatch):
    from catalog import sources

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb "), "id").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(sources, "folder", lambda spark: f"{tmp_path}/out")
    monkeypatch.setattr(sources.V, "table", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet"))
    found = sources.a05(spark, f"{tmp_path}/in").first()
    assert (found.n, found.chars) == (2000, sum(len(f"a b {i}") for i in range(2000)))
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("*.txt")) <= sources.FILE_LINES


def test_questions_jsonl(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    rows = [{"question_id": "1", "question": "q", "required_evidence_groups": [[" a ", None, ""], "x", [], None, ["b"]]}, {"question_id": "2", "question": "r"}]
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    got = files.load_questions_jsonl(spark, str(path)).orderBy("question_id").collect()
    assert [r.required_evidence_groups for r in got] == [[["a"], ["b"]], []]
    assert got[1].expected_doc_ids == [] and got[1].gold_answer == ""
    assert files.load_questions_jsonl(spark, str(path), 1).count() == 1


def test_jsonl_keeps_unicode(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([("é知", None)], "a string, b string").coalesce(1), str(tmp_path / "o"))
    line = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8").strip()
    assert line == '{"a":"é知","b":null}'


def test_traces(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"), ("a", "2024-01-03 00:10:00")], "debug_id string, at string").select(
        "debug_id", F.col("at").cast("timestamp").alias("created_at"))
    sinks.append_traces(rows.limit(2), folder)
    sinks.append_traces(rows.filter("created_at > '2024-01-02 12:00:00'"), folder)
    assert str(sinks.find_trace(spark, folder, "a").first().trace_date) == "2024-01-03"
    assert sinks.find_trace(spark, folder, "zzz").count() == 0


def test_parts(spark):
    rows = spark.range(23).select(F.format_string("%03d", "id").alias("key")).repartition(5)
    parts = [[r.key for r in tables.contiguous_part(rows, 4, i, "key").orderBy("key").collect()] for i in range(1, 5)]
    assert [len(p) for p in parts] == [6, 6, 6, 5] and sum(parts, []) == [f"{i:03d}" for i in range(23)]
    for n, i in ((0, 1), (3, 0), (3, 4)):
        with pytest.raises(ValueError):
            tables.contiguous_part(rows, n, i, "key")


def test_delete_where_keeps_unknown(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "o string")
    assert tables.delete_where(rows, F.col("o") == "a").count() == 2


def talk(n_sessions=5, n=60, seed=1):
    """One session holds most of the messages."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(1, n_sessions)}", i, i, rng.choice(["user", "user", "assistant", "system"]), f"m{i}") for i in range(n)]
    return rows


MESSAGES = "session_id string, created_at int, id int, role string, content string"


def paired(rows):
    out = []
    for session in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == session]
        pairs = [(a[4], b[4]) for a, b in zip(mine, mine[1:]) if (a[3], b[3]) == ("user", "assistant")]
        out += [(session, i, *p) for i, p in enumerate(pairs)]
    return sorted(out)


def test_pair_turns(spark):
    rows = talk()
    for parts in (1, 7):
        got = sessions.pair_turns(spark.createDataFrame(rows, MESSAGES).repartition(parts)).select("session_id", "turn_no", "user_text", "assistant_text")
        assert sorted(map(tuple, got.collect())) == paired(rows)


def test_memory_context_defaults(spark):
    made = spark.range(12).select(F.lit("s").alias("session_id"), F.col("id").alias("turn_no"), F.lit("u").alias("user_text"), F.lit("a").alias("assistant_text"))
    memory = spark.createDataFrame([("s", "old", 2)], "session_id string, summary string, summarized_turn_count int")
    shown = sessions.memory_context(made, memory).collect()
    assert sorted(r.turn_no for r in shown) == [6, 7, 8, 9, 10, 11] and {r.compressed_turns for r in shown} == {6}
    assert sorted(r.turn_no for r in sessions.summary_slice(made, memory).collect()) == [2, 3, 4, 5]
    assert sessions.memory_context(made.limit(10), memory).count() == 10
    assert sessions.summary_slice(made.limit(10), memory).count() == 0
    summary = sessions.fallback_summary(sessions.summary_slice(made, memory), memory).first()
    assert summary.summary.startswith("old\n新增历史摘要：\n- 用户询问：u；助手回答：a") and summary.summarized_turn_count == 6


def stream_of(spark, rows, schema, folder, batches):
    """Files that arrive one per batch, in order."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(frame, folder):
    frame.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(folder + "/out")


def test_stream_turns_equal_batch(spark, tmp_path):
    rows = talk()
    stream = stream_of(spark, rows, MESSAGES, str(tmp_path / "in"), 4)
    got = collected(turns.stream_pair_turns(stream), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == paired(rows)


def test_stream_slices(spark, tmp_path):
    rows = [("s", i, f"u{i}", f"a{i}") for i in range(12)]
    schema = "session_id string, turn_no bigint, user_text string, assistant_text string"
    got = collected(turns.stream_summary_slices(stream_of(spark, rows, schema, str(tmp_path / "in"), 3), 2, 4), str(tmp_path))
    assert sorted(r.turn_no for r in got.collect()) == list(range(10))


def judged(rows, limit, seconds):
    out = []
    for key in {r[0] for r in rows}:
        start = None
        for _, event, at in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if start is None or at >= start + seconds:
                start, count = at, 0
            count += count < limit or 0
            out.append((key, event, start * 1_000_000, sum(1 for o in out if o[0] == key and o[2] == start * 1_000_000 and o[3]) < limit))
    return sorted(out)


def test_admission(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", i, rng.randint(0, 900)) for i in range(300)), key=lambda r: r[2])
    schema = "key string, event_id bigint, s int"

    def timed(df):
        return df.select("key", "event_id", F.timestamp_seconds("s").alias("ts"))

    want = judged(rows, 2, 7)
    batch = admission.admission_windows(timed(spark.createDataFrame(rows, schema).repartition(6)), 2, 7)
    assert sorted((r.key, r.event_id, r.window_start, r.admitted) for r in batch.collect()) == want
    stream = collected(admission.stream_admission_windows(timed(stream_of(spark, rows, schema, str(tmp_path / "in"), 3)), 2, 7), str(tmp_path))
    assert sorted((r.key, r.event_id, r.window_start, r.admitted) for r in stream.collect()) == want


def test_stream_ingest_over_batches(spark, tmp_path):
    rows = [(f"p{i}", bytearray(f"t{i % 4}", "utf-8"), f"t{i % 4}") for i in range(12)]
    stream = stream_of(spark, rows, "path string, content binary, text string", str(tmp_path / "in"), 4)
    folder = str(tmp_path / "out")
    ingest.stream_ingest(stream, folder, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(folder).select("text").distinct().count() == spark.read.parquet(folder).count() == 4


def test_stream_memories_over_batches(spark, tmp_path):
    rows = [(str(i), "u", "s", i, f" Likes {i % 3} ", "task", "0.5") for i in range(9)]
    schema = "id string, user_id string, session_id string, ordinal bigint, memory string, memory_type string, confidence string"
    folder = str(tmp_path / "out")
    ingest.stream_new_memories(stream_of(spark, rows, schema, str(tmp_path / "in"), 3), folder, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.memory for r in spark.read.parquet(folder).collect()) == ["Likes 0", "Likes 1", "Likes 2"]


@pytest.mark.parametrize("limit,chunk", [(2, 1), (3, 40), (50, 700)])
def test_a_busy_key_is_cut_and_judged_side_by_side(spark, limit, chunk):
    """Events without a gap are one island; its chunks give the rows of the plain loop."""
    rng, at, rows = random.Random(chunk), -30_000_000, []
    for i in range(4000):
        at += rng.choice([0, 1, 300_000, 900_000, 2_500_000, 6_900_000]) if i < 3900 else rng.randrange(20_000_000)
        rows += [("busy", i, at)] + ([("calm", 10**6 + i, at)] if i % 50 == 0 else [])
    events = spark.createDataFrame(rows, "key string, event_id long, micros long").select("key", "event_id", F.timestamp_micros("micros").alias("ts")).repartition(5)
    want, open_windows = {}, {}
    for key, event, micros in sorted(rows, key=lambda r: (r[2], r[1])):
        start, count = open_windows.get(key, (None, 0))
        if start is None or micros >= start + 7_000_000:
            start, count = micros, 0
        want[event] = (start, count < limit)
        open_windows[key] = (start, min(limit, count + 1))
    out = admission.admission_windows(events, limit, 7, chunk)
    assert {r.event_id: (r.window_start, r.admitted) for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be read together
    try:
        tasks = admission.admission_windows(events, limit, 7, chunk).where("key = 'busy'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def accepted_in_order(rows, threshold, store=()):
    """The plain loop: a row is kept unless a stored vector of its user or an earlier kept one is close to it."""
    held = [(user, np.asarray(v)) for user, v in store]
    kept = []
    for key, user, _, vector in sorted(rows, key=lambda r: r[2]):
        v = None if vector is None else np.asarray(vector)
        if v is not None and any(u == user and round(float(v @ h) / float(np.linalg.norm(v) * np.linalg.norm(h)), 9) >= threshold for u, h in held):
            continue
        kept.append(key)
        if v is not None:
            held.append((user, v))
    return sorted(kept)


VECTORS = "id string, user_id string, ordinal bigint, embedding array<double>"


def turned(step):
    return [math.cos(step), math.sin(step)]


def test_semantic_duplicates_in_order(spark):
    """In a chain each row is close to its neighbours only: every second one stays, not just the first."""
    rng = random.Random(9)
    rows = [(f"c{i}", "chain", i, turned(0.05 * i)) for i in range(9)]
    rows += [(f"r{i}", rng.choice(["hot", "hot", "u"]), 100 + i, turned(rng.uniform(0, 6))) for i in range(60)]
    rows += [(f"n{i}", "hot", 200 + i, None) for i in range(2)] + [("copy", "u", 300, rows[-1][3])]
    store = [("s0", "hot", turned(1.0), "active"), ("s1", "u", turned(2.0), "deleted")]
    held = spark.createDataFrame(store, "id string, user_id string, embedding array<double>, status string")
    out = memories.drop_semantic_duplicates(spark.createDataFrame(rows, VECTORS).repartition(5), held, 0.998)
    want = accepted_in_order(rows, 0.998, [("hot", store[0][2])])
    assert out.columns == ["id", "user_id", "ordinal", "embedding"] and sorted(r.id for r in out.collect()) == want
    assert {f"c{i}" for i in range(0, 9, 2)} == {k for k in want if k.startswith("c") and k != "copy"}
    assert memories.drop_semantic_duplicates(spark.createDataFrame([], VECTORS), held).count() == 0


def test_memory_stream_by_meaning(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(i), f"u{rng.randint(0, 4)}", i, turned(rng.uniform(0, 6)), "s", f"Likes {i}", "task", "0.5") for i in range(45)]
    rows += [("late", rows[0][1], 99, None, "s", "likes  0", "task", "0.5")]
    schema = VECTORS + ", session_id string, memory string, memory_type string, confidence string"
    folder = str(tmp_path / "out")
    stream = stream_of(spark, rows, schema, str(tmp_path / "in"), 3)
    ingest.stream_new_memories(stream, folder, str(tmp_path / "state"), threshold=0.99).awaitTermination()
    stored = spark.read.parquet(folder)
    want = accepted_in_order([r[:4] for r in rows[:-1]], 0.99)
    assert sorted(r.id for r in stored.collect()) == want and 5 < len(want) < 45
    assert stored.select("batch_id").distinct().count() == 3


def test_a_batch_of_memories_reads_the_buckets_of_its_users(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(str(i), f"u{i}", "h", "active") for i in range(40)], "id string, user_id string, hash string, status string")
    for batch in (0, 1):
        rows.withColumn("bucket", ingest.user_bucket()).write.partitionBy("bucket").parquet(f"{folder}/batch_id={batch}")
    batch = rows.where("user_id in ('u3', 'u8')")
    read = ingest.memories_of(batch, folder, "id string, user_id string, hash string, status string", 1)
    touched = sorted({r.bucket for r in batch.select(ingest.user_bucket()).collect()})
    pushed = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "NOT (batch_id" in pushed and all(str(b) in pushed for b in touched) and "bucket" in pushed
    assert {"u3", "u8"} <= {r.user_id for r in read.collect()}


def kept_states(frame, folder):
    """Rows of a finished stream, and the states it holds after each micro-batch."""
    query = frame.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(folder + "/out"), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_windows_leave_the_state_behind_the_watermark(spark, tmp_path):
    """Keys come and go: states stay few, the rows are those of the plain loop."""
    rng = random.Random(6)
    rows = sorted(((f"k{(s // 300) * 4 + rng.randrange(4)}", i, s) for i, s in enumerate(rng.choices(range(1, 3000), k=400))), key=lambda r: r[2])
    events = stream_of(spark, rows, "key string, event_id bigint, s int", str(tmp_path / "in"), 8).select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    got, states = kept_states(admission.stream_admission_windows(events, 2, 20, late="10 seconds"), str(tmp_path))
    assert sorted((r.key, r.event_id, r.window_start, r.admitted) for r in got.collect()) == judged(rows, 2, 20)
    assert max(states) < len({r[0] for r in rows}) / 2 and states[-1] <= 4


def test_idle_sessions_leave_the_state(spark, tmp_path):
    rows = [(f"s{i // 10}", i, i, ("user", "assistant")[i % 2], f"m{i}") for i in range(200)]
    stream = stream_of(spark, rows, MESSAGES, str(tmp_path / "in"), 5).withColumn("created_at", F.timestamp_seconds(F.lit(1000) + F.col("id")))
    got, states = kept_states(turns.stream_pair_turns(stream, idle="20 seconds", late="5 seconds"), str(tmp_path))
    assert sorted(map(tuple, got.collect())) == paired(rows)
    assert states[-1] <= 4 < len({r[0] for r in rows})
    # the turns as a stream of their own: what waits for a summary goes with its session
    made = [(s, n, u, a, 1000 + 10 * int(s[1:]) + n) for s, n, u, a in paired(rows)]
    made.sort(key=lambda r: r[4])
    timed = stream_of(spark, made, "session_id string, turn_no bigint, user_text string, assistant_text string, s int", str(tmp_path / "turns"), 5).withColumn("created_at", F.timestamp_seconds("s"))
    slices, states = kept_states(turns.stream_summary_slices(timed, 1, 2, idle="20 seconds", late="5 seconds"), str(tmp_path / "slices"))
    assert sorted((r.session_id, r.turn_no) for r in slices.collect()) == sorted((r[0], r[1]) for r in made if r[1] < 4)
    assert states[-1] <= 4
    with pytest.raises(TypeError, match="timestamp"):
        turns.stream_pair_turns(stream.withColumn("created_at", F.col("id")), idle="1 hour")


def test_keyword_search_equals_the_plain_match(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "gam_ma", "GAMXMA", "50%", "x1", "日本語", "zz", "alphabet"]
    store = [(f"m{i:03d}", "hot" if i % 3 else "u", " ".join(rng.sample(words, 4)), "active" if i % 10 else "deleted", i % 7) for i in range(120)]
    queries = [("q1", "hot", "alpha, BETA"), ("q2", "hot", "gam_ma"), ("q3", "u", "50%"), ("q4", "u", "zz x1"), ("q5", "hot", "日本語 alphabet"),
               ("q6", "u", "missing"), ("q7", "nobody", "alpha"), ("q8", "hot", "alpha"), ("q9", "u", "a")]
    held = spark.createDataFrame(store, "id string, user_id string, memory string, status string, s int").withColumn("created_at", F.timestamp_seconds("s"))
    asked = spark.createDataFrame(queries, "query_id string, user_id string, query string").repartition(3)
    got = memories.keyword_search_memories(asked, held, asked.where("query_id = 'q8'"), k=5)
    want = []
    for query, user, text in queries:
        needles = [re.escape(w.lower()).replace("%", ".*").replace("_", ".") for w in re.split("[, ]+", text) if len(w) >= 2]
        hits = [r for r in store if r[1] == user and r[3] == "active" and needles and all(re.search(n, r[2].lower()) for n in needles)] if query != "q8" else []
        want += [(query, r[0], i) for i, r in enumerate(sorted(hits, key=lambda r: (-r[4], [-ord(c) for c in r[0]]))[:5], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[0] for w in want} == {"q1", "q2", "q3", "q4", "q5"}


def test_merged_sketches(spark):
    """A hot stage over many days; a range of days is answered from its own sketches."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("stage"), F.timestamp_seconds(F.col("id") * 10).alias("ts"),
                                       F.when(F.col("id") % 1000 == 1, None).otherwise(F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double")).alias("ms"))
    sketches = latency.stage_sketches(rows).cache()
    days = sketches.select("window_start").distinct().count()
    assert days == 24 and sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 50_000
    for since, until in ((None, None), ("1970-01-05", "1970-01-09")):
        found = {r.stage: r for r in latency.merged_latency(sketches, since, until).collect()}
        part = rows.where("ms is not null") if since is None else rows.where("ms is not null and ts >= '1970-01-05' and ts < '1970-01-09'")
        for stage, mine in found.items():
            exact = sorted(r.ms for r in part.where(F.col("stage") == stage).collect())
            assert mine.n == len(exact) and abs(mine.avg_ms - sum(exact) / len(exact)) < 1e-6
            for q, value in ((0.5, mine.p50_ms), (0.95, mine.p95_ms)):
                assert abs(np.searchsorted(exact, value, "right") / len(exact) - q) <= 0.015
    sketches.unpersist()
    assert latency.merged_latency(latency.stage_sketches(rows.limit(0))).count() == 0

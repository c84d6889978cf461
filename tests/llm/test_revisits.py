import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm.revisits import PERMITTED, Revisits, canonical_url, resolved_revisits

SCHEMA = "record_id long, kind string, url string, ts long, headers map<string,string>, payload string, outcome string, _full int"


def plain(rows):
    out = {}
    full = [r for r in rows if r[1] == "response" and r[2] is not None and r[3] is not None]
    for i, kind, url, ts, h, body in rows:
        h = {k.lower(): v for k, v in (h or {}).items()}
        if kind == "response":
            out[i] = ("full", i, h, body)
            continue
        earlier = [r for r in full if url is not None and ts is not None and r[2] == url and r[3] < ts]
        if not earlier:
            out[i] = ("missing", None, h, None)
            continue
        s = max(earlier, key=lambda r: (r[3], r[0]))
        stored = {k.lower(): v for k, v in (s[4] or {}).items()}
        tag = lambda m: m["etag"].removeprefix("W/") if "etag" in m else None
        if tag(h) and tag(stored):
            outcome = "etag" if tag(h) == tag(stored) else "changed"
        elif "last-modified" in h and "last-modified" in stored:
            outcome = "last-modified" if h["last-modified"] == stored["last-modified"] else "changed"
        else:
            outcome = "unproven"
        ok = outcome in ("etag", "last-modified")
        out[i] = (outcome, s[0], stored | {k: v for k, v in h.items() if k in PERMITTED} if ok else h, s[5] if ok else None)
    return out


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_equal_to_brute_force(spark, slices):
    rng = random.Random(slices)
    rows = []
    for i in range(600):
        url = rng.choice(["hot.org/a"] * 5 + ["b.org", "c.org/x?y=1", None])
        h = {k: v for k, v in {"ETag": rng.choice(['"1"', 'W/"1"', '"2"']), "Last-Modified": rng.choice(["x", "y"]), "Content-Type": "t", "Date": str(i), "Expires": "e"}.items() if rng.random() < 0.6}
        rows.append((i, rng.choice(["response", "revisit", "revisit", None]), url, rng.choice([None, *range(200)]), h if rng.random() < 0.9 else None, f"p{i}"))
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA).repartition(5)
    got = {r.record_id: (r.outcome, r.source_id, r.headers, r.payload) for r in resolved_revisits(df, Revisits(slices=slices)).collect()}
    assert got == plain(rows)


def test_repeats_and_empty(spark):
    rows = [(1, "response", "a.org", 1, {"ETag": "x"}, "p"), (1, "response", "a.org", 1, {"ETag": "x"}, "p"), (2, "revisit", "a.org", 2, {"ETag": "x"}, None), (2, "revisit", "a.org", 2, {"ETag": "x"}, None),
            (None, "revisit", "a.org", 2, None, None)]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA)
    assert sorted((r.record_id, r.outcome, r.payload) for r in resolved_revisits(df).collect()) == [(1, "full", "p")] * 2 + [(2, "etag", "p")] * 2
    assert resolved_revisits(df.limit(0)).count() == 0


def test_ids_that_several_records_share(spark):
    tag, other = {"ETag": "x"}, {"ETag": "y"}
    rows = [(1, "response", "a.com/x", 1, tag, "ax"), (1, "response", "b.com/y", 1, other, "by"), (1, "response", "a.com/x", 5, tag, "ax5"),
            (9, "revisit", "a.com/x", 3, tag, None), (9, "revisit", "b.com/y", 3, other, None), (9, "revisit", "a.com/x", 7, tag, None), (9, "revisit", None, 7, tag, None), (9, "revisit", "a.com/x", 1, tag, None),
            (2, "response", "c.com", 1, tag, "q"), (2, "response", "c.com", 1, tag, "p"), (9, "revisit", "c.com", 2, tag, None)]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA)
    for parts in (1, 5):
        got = sorted((r.url_key or "", r.ts, r.outcome, r.source_id or 0, r.payload or "") for r in resolved_revisits(df.repartition(parts)).where("record_id = 9").collect())
        assert got == [("", 7, "missing", 0, ""), ("a.com/x", 1, "missing", 0, ""), ("a.com/x", 3, "etag", 1, "ax"), ("a.com/x", 7, "etag", 1, "ax5"), ("b.com/y", 3, "etag", 1, "by"), ("c.com", 2, "etag", 2, "p")]
        assert resolved_revisits(df.repartition(parts)).count() == len(rows)


def test_canonical_urls(spark):
    urls = {"https://www.Ex.org:443/A/?utm_source=x&b=2&ref=y#top": "ex.org/A?b=2", "http://ex.org": "ex.org", "HTTP://u:p@ex.org/?fbclid=1": "ex.org", "ex.org/a?refer=1": "ex.org/a?refer=1", None: None, "": ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.c for r in df.select(canonical_url(F.col("url")).alias("c")).collect()] == list(urls.values())

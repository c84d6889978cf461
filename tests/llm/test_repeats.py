import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import substrings, suffixes, windows
from lodestone.llm.sketches import Shape

SMALL = Shape(2, 20)


def plain_bytes(texts, length):
    """Kept bytes, removed count and runs of each text, by looking up every string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        marks = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                marks[i:i + length] = [True] * length
        runs = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
        out.append((len(b), sum(marks), runs, bytes(c for c, m in zip(b, marks, strict=True) if not m)))
    return out


def plain_words(rows, length):
    split = [(k, (t or "").encode().split()) for k, t in rows]
    order = lambda k: (k is not None, k or 0)
    first = {}
    for k, w in split:
        for i in range(len(w) - length + 1):
            s = tuple(w[i:i + length])
            first[s] = min(first.get(s, ((True, 1 << 60), 0)), (order(k), i))
    out = []
    for k, w in split:
        marks = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < (order(k), i):
                marks[i:i + length] = [True] * length
        out.append((k, len(w), sum(marks), b" ".join(x for x, m in zip(w, marks, strict=True) if not m).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["la", "tion", "über", "xyzzy", "é", "the", "of", "and", "q", "中文", "ring", "st"]
    some = lambda n: " ".join("".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    passages = [some(n) for n in (30, 45, 60, 90)]
    texts = [some(rng.choice([0, 3, 25, 80, 200])) for _ in range(25)]
    texts += [f"{some(20)} {rng.choice(passages)} {some(15)} {rng.choice(passages)}" for _ in range(25)]
    texts += [rng.choice(texts) for _ in range(8)]
    for t in list(texts[25:40]):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append("  ".join(w))
    return [*texts, None, "", " \t\n", "ab " * 400, "ab " * 350, "a" * 900, passages[0], passages[3][:-7], "\x00" * 300 + "z", some(6000)]


@pytest.mark.parametrize("piece,together", [(300, 4096), (1 << 20, 3)])
def test_bytes_equal_brute_force(spark, piece, together, monkeypatch):
    monkeypatch.setattr(windows.gathered, "__defaults__", (piece,))
    texts = corpus(1)
    keys = [i if i % 7 else None for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in zip(keys, texts, strict=True)] + [(5, texts[5], 0, "x")], "doc_id long, text string, low long, body string").repartition(4)
    got = suffixes.without_repeats(df, suffixes.Threshold(shape=SMALL, together=together)).collect()
    want = plain_bytes([*texts, texts[5]], 200)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((k or -1, *w) for k, w in zip([*keys, 5], want, strict=True))


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_words_equal_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(windows.gathered, "__defaults__", (piece,))
    rows = [(i if i else None, t) for i, t in enumerate(corpus(2))] + [(30, corpus(2)[30])] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(4)
    got = substrings.without_repeats(df, substrings.Repeats(shape=SMALL)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in got) == sorted((k or -1, *rest) for k, *rest in plain_words(rows, 20))


def test_a_full_sketch_loses_nothing(spark):
    """With 1024 cells nearly every window passes the screen; the result stays the same."""
    rows = [(i, t) for i, t in enumerate(corpus(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.without_repeats(df, substrings.Repeats(shape=Shape(1, 10))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(plain_words(rows, 20))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty, suffixes.Threshold(shape=SMALL)).count() == 0
    assert substrings.without_repeats(empty, substrings.Repeats(shape=SMALL)).count() == 0


def test_every_window_has_its_leftmost_least_anchor():
    rng = np.random.default_rng(4)
    codes = windows.byte_codes()[rng.integers(0, 3, 700)]
    ends = np.array([0, 100, 100, 119, 500, 700])
    found = windows.stretches_of(codes, ends, 20, 6)
    grams = windows.Hashes(codes).runs(6) >> np.uint64(32)
    chosen = {p: a for lo, hi, a in zip(found.low, found.high, found.at, strict=True) for p in range(lo, hi + 1)}
    want = {p: p + int(np.argmin(grams[p:p + 15])) for s, e in zip([0, *ends[:-1]], ends, strict=True) for p in range(s, e - 19)}
    assert chosen == want

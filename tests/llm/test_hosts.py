import random
from collections import Counter

import pytest

from lodestone.llm import hosts
from lodestone.llm.batches import pieces
from lodestone.llm.hosts import HostRules, beta_prior, counts_of, host_rules, repeated_words

KINDS = "doc_id long, source string, text string"


def plain_repeats(words):
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(inside)


def test_counts_against_plain_loops():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "<", " ", "c ", "a b c "]) for _ in range(rng.randrange(80)))
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert counts_of(text.encode()) == (
            len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), plain_repeats(words)), repr(text)


def test_repeats_of_edge_texts():
    assert repeated_words([]) == repeated_words([b"a"] * 3) == 0 and repeated_words([b"a"] * 4) == 4
    many = [str(i).encode() for i in range(200_000)]
    assert repeated_words(many) == 0 and repeated_words([*many, *many[:3], b"x"]) == 6


def test_more_words_than_three_of_them_fit_a_number(monkeypatch):
    words = [str(i).encode() for i in range(3_000_000)]  # the cube passes 62 bits
    assert repeated_words([*words, *words[7:10]]) == 6


def text(kind, rng):
    words = [f"w{rng.randrange(5000)}" for _ in range(80)]
    if kind == "short":
        return "too few"
    if kind == "symbols":
        return " ".join(w + "$" if i % 4 == 0 else w for i, w in enumerate(words))
    return " ".join(words)


def corpus(spark):
    rng, rows = random.Random(6), []
    plan = {"clean": {"": 400}, "symbolic": {"": 100, "symbols": 100}, "once": {"symbols": 1}, "junk": {"short": 190, "": 10}, "common": {"": 900, "symbols": 9, "short": 9}}
    for host, kinds in plan.items():
        rows += [(len(rows) + i, host, text(k, rng)) for i, k in enumerate(k for k, n in kinds.items() for _ in range(n))]
    rows += [(10**6 + i, f"small{i}", text("", rng)) for i in range(300)] + [(2 * 10**6 + i, f"pair{i // 2}", text("", rng)) for i in range(400)]
    return rows


def test_verdicts_come_from_hosts(spark):
    rows = corpus(spark)
    out = {r.doc_id: r for r in host_rules(spark.createDataFrame(rows, KINDS).repartition(5)).collect()}
    assert len(out) == len({r[0] for r in rows})
    for i, host, t in rows:
        failed, symbolic = len(t.split()) < 50, "$" in t
        assert out[i].base_failed == failed and out[i].host_rejected == (host == "junk"), host
        assert out[i].kept == (not failed and host != "junk" and not (symbolic and host == "symbolic")), (host, t[:20])


def test_every_host_joins_whatever_its_size(spark):
    rows = spark.createDataFrame(corpus(spark), KINDS)
    wide = {(r.doc_id, r.kept) for r in host_rules(rows, HostRules(split=1)).collect()}  # no host is broadcast
    assert wide == {(r.doc_id, r.kept) for r in host_rules(rows, HostRules(split=10**6)).collect()}


def test_edge_rows(spark):
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, None, None, 5), (1, None, words, 6), (None, "a", "", 7), (2, "a", words, 8), (2, "a", words, 8), (3, "a", "x " * 200_000, 9)], KINDS + ", n_words int")
    out = host_rules(docs, HostRules(rejected=0.99))
    assert out.columns.count("n_words") == 1 and out.count() == 6
    found = sorted(((r.doc_id or 0, r.source or "", r.n_words, r.n_repeat_words, r.kept) for r in out.collect()))
    assert found == [(0, "a", 0, 0, False), (1, "", 0, 0, False), (1, "", 60, 0, True), (2, "a", 60, 0, True), (2, "a", 60, 0, True), (3, "a", 200_000, 200_000, False)]
    assert host_rules(docs.limit(0)).count() == 0


def test_prior_by_moments():
    cfg = HostRules()
    # rates drawn from Beta(2, 6): mean 1/4, E[p^2] = 2*3/(8*9)
    prior = beta_prior(100, 25, 10, 0.25, 6 / 72, cfg)
    assert prior.mean == 0.25 and prior.strength == pytest.approx(8.0)
    assert beta_prior(100, 25, 10, 0.25, 0.0625, cfg).strength == cfg.strongest
    assert beta_prior(10, 5, 0, None, None, cfg) == hosts.BetaPrior(0.5, cfg.strongest) and beta_prior(0, 0, 0, None, None, cfg).mean == 0.0
    assert beta_prior(100, 50, 10, 0.5, 0.5, cfg).strength == cfg.weakest


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 50, "", "c", "d" * 7])], ["t"])
    parts = [p.column("t").to_pylist() for p in pieces([batch.slice(1), batch.slice(0, 0)], "t", most=8)]
    assert parts == [[None], ["b" * 50], ["", "c", "d" * 7]]
    lists = pa.record_batch([pa.array([[1, 2], None, [3], []])], ["t"])
    assert [p.num_rows for p in pieces([lists], "t", most=16)] == [2, 2]

"""Host-level quality rules: shrunk failure rates of each host decide which rules bind its documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces
from lodestone.session import cut_lineage, stack

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
BASE = ["few_words", "repeated"]
#: Rules that hold a document back only where its host fails them too often.
HOST_RULES = ["short_words", "long_words", "symbols", "dup_lines", "repeats"]


@dataclass(frozen=True)
class HostRules:
    """Bounds of the rules (percentages of words or lines, characters a word) and of the verdicts.

    A rate is judged by the lower end of its posterior, ``deviations`` standard deviations below the mean: above ``binding``
    the rule binds the host's documents, and a host whose share of base failures lies above ``rejected`` is rejected.  The
    strength of the prior, in documents, is kept between ``weakest`` and ``strongest``.  Hosts with more than one in
    ``split`` of all documents, fewer than ``split`` of them, are joined by broadcast.
    """
    least_words: int = 50
    repeated: int = 50
    repeats: int = 20
    symbols: int = 10
    dup_lines: int = 30
    short_word: int = 3
    long_word: int = 12
    binding: float = 0.2
    rejected: float = 0.5
    deviations: float = 2.0
    weakest: float = 2.0
    strongest: float = 10_000.0
    split: int = 1000


@dataclass(frozen=True)
class BetaPrior:
    """Failures before any document of a host is seen: ``mean`` of them in ``strength`` documents."""
    mean: float
    strength: float

    def low_end(self, n: Column, fails: Column, deviations: float) -> Column:
        """Posterior mean less ``deviations`` posterior standard deviations."""
        mean = (fails + F.lit(self.mean * self.strength)) / (n + F.lit(self.strength))
        return mean - F.lit(deviations) * F.sqrt(mean * (F.lit(1.0) - mean) / (n + F.lit(self.strength + 1.0)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more in the text."""
    if len(words) < 4:
        return 0
    table = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    pair, size = code[:-2] * len(table) + code[1:-1], len(table) ** 2
    if size * len(table) >= 1 << 62:
        _, pair = np.unique(pair, return_inverse=True)
    windows = pair * len(table) + code[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(windows, np.unique(twice))
    inside = np.zeros(len(words), bool)
    for ahead in range(3):
        inside[ahead:ahead + len(starts)] |= starts
    return int(inside.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, BLANKS).decode()), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def counted(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``(key, host)`` and ``COUNTS`` for each row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = np.array([counts_of(t.as_py() or b"") for t in part.column("text").cast(pa.large_binary())], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["key", "host", *COUNTS])

    slim = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    return slim.mapInArrow(run, slim.select("key", "host", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema)


def failures(cfg: HostRules) -> dict[str, Column]:
    """Whether a row of ``counted`` fails each rule."""
    words, hundred = F.col("n_words"), F.lit(100)
    return {
        "few_words": words < cfg.least_words,
        "repeated": hundred * F.col("n_repeat_words") > cfg.repeated * words,
        "short_words": F.col("word_chars") < cfg.short_word * words,
        "long_words": F.col("word_chars") > cfg.long_word * words,
        "symbols": hundred * F.col("n_symbols") > cfg.symbols * words,
        "dup_lines": hundred * F.col("n_dup_lines") > cfg.dup_lines * F.col("n_lines"),
        "repeats": hundred * F.col("n_repeat_words") > cfg.repeats * words,
    }


def beta_prior(n: int, fails: int, hosts: int, mean: float | None, pairs: float | None, cfg: HostRules) -> BetaPrior:
    """A beta distribution by its moments over hosts of two documents or more, each host counting once.

    ``mean`` is the average failure rate, ``pairs`` the average chance that two documents of a host both fail.  Hosts that
    differ no more than by chance, or hosts of one document only, give the strongest prior.
    """
    if not hosts:
        return BetaPrior(fails / n if n else 0.0, cfg.strongest)
    spread = pairs - mean * mean
    strength = (mean - pairs) / spread if spread > 0 else cfg.strongest
    return BetaPrior(mean, min(max(strength, cfg.weakest), cfg.strongest))


def host_verdicts(measured: DataFrame, cfg: HostRules) -> tuple[DataFrame, int]:
    """``(host, n, host_rejected, bind_<rule> ...)`` and the number of all rows; a null host is a host of its own.

    Failures are added up within each task before rows meet by host, and one row of moments reaches the driver.
    """
    rules = failures(cfg)
    base = reduce(lambda a, b: a | b, [rules[r] for r in BASE])
    fails = {"base": base, **{r: rules[r] for r in HOST_RULES}}
    hosts = cut_lineage(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"k_{r}") for r, c in fails.items()]))
    n, many = F.col("n").cast("double"), F.col("n") > 1
    moments = [F.sum("n").alias("n"), F.count_if(many).alias("hosts")]
    for r in fails:
        k = F.col(f"k_{r}").cast("double")
        moments += [F.sum(f"k_{r}").alias(f"k_{r}"), F.avg(F.when(many, k / n)).alias(f"m_{r}"), F.avg(F.when(many, k * (k - 1) / (n * (n - 1)))).alias(f"p_{r}")]
    seen = hosts.agg(*moments).first()
    total = seen["n"] or 0
    low = {r: beta_prior(total, seen[f"k_{r}"] or 0, seen["hosts"], seen[f"m_{r}"], seen[f"p_{r}"], cfg).low_end(n, F.col(f"k_{r}"), cfg.deviations) for r in fails}
    return hosts.select("host", "n", (low["base"] > cfg.rejected).alias("host_rejected"), *[(low[r] > cfg.binding).alias(f"bind_{r}") for r in HOST_RULES]), total


def host_rules(docs: DataFrame, cfg: HostRules | None = None, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``(key, host)``, ``COUNTS``, ``base_failed``, ``host_rejected``, ``bound_failures`` and ``kept`` for each row.

    A text fails at base with fewer than ``least_words`` words or too many repeated ones.  The further rules decide only
    together with the host: failures are added up by host, the rates shrunk towards a beta prior fitted to all hosts, and a
    rule binds where a host's shrunk rate is surely too high.  ``kept`` is false for base failures, for all documents of a
    rejected host and for those that fail a rule that binds their host; ``bound_failures`` counts the last.

    Null and empty texts have no words and fail at base; a null host is one host; rows that share a key, and repeated rows,
    count each and come back each; other columns are ignored, whatever their names; an empty table gives an empty result.  One text is held
    by a task at a time, with some multiples of its size.
    """
    cfg = cfg or HostRules()
    measured = cut_lineage(counted(docs, key, host, text))
    hosts, total = host_verdicts(measured, cfg)
    hosts = cut_lineage(hosts).withColumnRenamed("host", "_host")
    large = F.broadcast(hosts.where(F.col("n") * cfg.split > total))  # fewer than ``split`` rows, whatever the corpus
    same = F.col("host").eqNullSafe(F.col("_host"))
    rest = measured.join(large.select("_host"), same, "left_anti").join(hosts.where(F.col("n") * cfg.split <= total), same)
    joined = stack(measured.join(large, same), rest)
    rules = failures(cfg)
    bound = reduce(lambda a, b: a + b, [(rules[r] & F.col(f"bind_{r}")).cast("int") for r in HOST_RULES])
    judged = joined.withColumn("base_failed", reduce(lambda a, b: a | b, [rules[r] for r in BASE])).withColumn("bound_failures", bound)
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & (F.col("bound_failures") == 0)
    return judged.select(F.col("key").alias(key), F.col("host").alias(host), *COUNTS, "base_failed", "host_rejected", "bound_failures", kept.alias("kept"))

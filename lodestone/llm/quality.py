"""A sparse rule ensemble: paths of trees become rules, lasso weights thin them out, columns apply them."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import islice
from math import log, log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces
from lodestone.session import cut_lineage

#: Rules see these statistics of a text and nothing else.
STATISTICS = ["log_chars", "log_words", "word_length", "distinct_words", "repeated_words", "letters", "upper", "digits",
              "symbols", "sentence_ends", "bars", "line_words", "distinct_lines", "doubled_marks"]
#: Labelled rows that a fit reads at most; they are those with the smallest hashes of their ids.
FIT_ROWS = 20_000
THRESHOLD = 0.3


LETTER, UPPER, DIGIT, MARK, SYMBOL, BLANK = 1, 2, 3, 4, 5, 6


@cache
def _classes() -> np.ndarray:
    """A class for each code point: other letters, capitals, decimal digits, common marks, other symbols, blanks."""
    out = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LM":
            out[point] = UPPER if kind == "Lu" else LETTER
        elif kind[0] == "N":
            out[point] = DIGIT if kind == "Nd" else LETTER
        elif kind[0] == "Z":
            out[point] = BLANK
    out[[ord(c) for c in " \t\n\r\x0b\x0c"]] = BLANK
    out[[ord(c) for c in ".,;:'\"?!()-"]] = MARK
    return out


def statistics_of(text: bytes) -> list[float]:
    """The values of ``STATISTICS``; all zero for a blank text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    kinds = _classes()[points]
    n, w = len(points), len(words)
    count = np.bincount(kinds, minlength=BLANK + 1).tolist()
    letters = count[LETTER] + count[UPPER]
    lines = [x for x in text.split(b"\n") if x]
    marks = (kinds == MARK) | (kinds == SYMBOL)
    doubled = int((marks[1:] & (points[1:] == points[:-1])).sum())
    ends = np.isin(points, [ord(c) for c in ".?!"]) & np.append(kinds[1:] == BLANK, True)
    again = sum(map(eq, words, islice(words, 1, None)))
    return [log1p(n), log1p(w), n / w, len(set(words)) / w, again / w, letters / n, count[UPPER] / letters if letters else 0.0, count[DIGIT] / n,
            count[SYMBOL] / n, int(ends.sum()) / w, text.count(b"|") / w, w / len(lines), len(set(lines)) / len(lines), doubled / w]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``_stats``, in place of one of that name; a null or blank text has zero in all of them."""
    rest = [c for c in df.columns if c != "_stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            values = np.array([statistics_of(t.as_py() or b"") for t in batch.column(text).cast(pa.large_binary())]).reshape(-1, len(STATISTICS))
            stats = pa.StructArray.from_arrays([pa.array(values[:, i], pa.float64()) for i in range(len(STATISTICS))], STATISTICS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), stats], [*rest, "_stats"])

    kind = "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">"
    return df.select(*rest).mapInArrow(run, df.select(*rest, F.lit(None).cast(kind).alias("_stats")).schema)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col(f"_stats.{self.statistic}")
        return value > self.bound if self.above else value <= self.bound


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """``intercept`` plus the weights of the rules that hold, as log odds of label 1."""
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, as a column over ``_stats``."""
        odds = reduce(lambda total, rule: total + F.when(_holds(rule[0]), F.lit(rule[1])).otherwise(F.lit(0.0)), self.weights, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def _simplified(path: list[Condition]) -> Rule:
    """At most one lower and one upper bound for each statistic, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for c in path:
        at = (c.statistic, c.above)
        tight[at] = c.bound if at not in tight else max(tight[at], c.bound) if c.above else min(tight[at], c.bound)
    return tuple(Condition(s, above, bound) for (s, above), bound in sorted(tight.items()))


def tree_rules(tree) -> list[Rule]:
    """The path to every node of a fitted tree but its root, as a conjunction."""
    rules, todo = [], [(tree._call_java("rootNode"), [])]
    while todo:
        node, path = todo.pop()
        if path:
            rules.append(_simplified(path))
        if node.subtreeDepth() > 0:
            split = node.split()
            name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
            todo += [(node.leftChild(), [*path, Condition(name, False, bound)]), (node.rightChild(), [*path, Condition(name, True, bound)])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = FIT_ROWS, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Trees on the statistics of at most ``fit_rows`` labelled texts give the rules; a lasso-penalised logistic
    regression on what they say gives the weights.

    Labels other than 0 and 1, and labels without a text, are not used; repeated ones count again.  Where only one label is
    seen, or none, the ensemble has no rules and one constant score.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    # bounded by fit_rows, so the small side of the join stays small whatever the corpus
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
              .orderBy(F.xxhash64("_key", F.lit(seed)), "_key", "_label").limit(fit_rows))
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    seen = cut_lineage(with_statistics(labelled, "_text").select("_label", "_stats").repartition(8))
    counts = {r["_label"]: r["count"] for r in seen.groupBy("_label").count().collect()}  # two rows at most
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        return RuleEnsemble(log((good + 1) / (bad + 1)), ())

    flat = seen.select("_label", *[F.col(f"_stats.{s}").alias(s) for s in STATISTICS])
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(flat)
    forest = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree)}, key=repr)
    if not rules:
        return RuleEnsemble(log(good / bad), ())
    said = seen.select("_label", *[_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    wide = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(said)
    model = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=lasso, standardization=True, maxIter=40, tol=1e-5).fit(wide)
    weights = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-6)
    return RuleEnsemble(float(model.intercept), weights)


def held_out(key: Column) -> Column:
    """Rows whose labels no fit may see; a null key is one of them."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def scored(docs: DataFrame, ensemble: RuleEnsemble, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, from 0 to 1, larger where label 1 is likelier; null and empty texts get a score as well.

    All columns and rows pass through, whatever their names; a column of the same name as ``name`` is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    # the caller's columns under private names, so that none meets the statistics
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    found = with_statistics(slim, f"c{kept.index(text)}").withColumn("score", ensemble.score())
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("score").alias(name))

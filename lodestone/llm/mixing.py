"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose plans may be sent to every task, some hundred bytes each; with more of them rows are salted.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: Cells of the histogram of order keys, per source; the cut is searched in one cell only.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """What a mix does: relative weights by rank of the source (repeating), share of all words, cap on copies.

    ``rounds`` is how often the order is gone on with behind a document that does not fit.
    """
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    share: float = 1.0
    cap: int = 3
    seed: int = 11
    rounds: int = 3


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``(_none, _source, source_size, target)`` from rows ``(_none, _source, _size)``.

    Sources are ranked by code point, null last, and take the weights in turn.  With all targets ``min(cap * size,
    level * weight)``, the level is the one at which they add up to the words asked for: that is where resharing the
    excess over the caps ends.  Sources are rows here, so the windows below hold one row a source, not their documents.
    """
    n = len(mix.weights)
    totals = sizes.groupBy("_none", "_source").agg(F.sum("_size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy("_none", "_source")) - 1) % n
    weighed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), rank + 1)).withColumn("_cap", F.col("source_size") * float(mix.cap))
    every, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_none", "_source").rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumns({
        "_asked": F.sum("source_size").over(every) * F.lit(float(mix.share)),
        "_all_w": F.sum("_w").over(every),
        "_done": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_done_w": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    }).withColumn("_level", (F.col("_asked") - F.col("_done")) / (F.col("_all_w") - F.col("_done_w")))
    # the first source, from the tightest cap on, that the level of the rest does not fill
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = levels.withColumn("_level", F.max(fits).over(every) if mix.share <= mix.cap else F.lit(None))
    return level.select("_none", "_source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).alias("target"))


def _measured(docs: DataFrame, key: str, text: str, source: str, weight: str | None, mix: Mix) -> DataFrame:
    """``_row`` with the caller's columns, and private ones: source, size, relative weight and a number in (0, 1) drawn from the row itself."""
    body = F.coalesce(F.col(text), F.lit(""))
    drawn = F.xxhash64(F.col(key), F.xxhash64(body), F.lit(mix.seed))
    weighed = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(key).alias("_key"), word_count(F.col(text)).alias("_size"), weighed.alias("_weight"),
        (F.shiftrightunsigned(drawn, 11) * F.lit(2.0 ** -53) + F.lit(2.0 ** -54)).alias("_u"))


def _by_source(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Each row with what its source has in ``plan``; no task gets all rows of a common source."""
    on = ["_none", "_source"]
    if small:
        return rows.join(F.broadcast(plan), on)
    copies = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.col("_u") * SALTS).cast("int")).join(copies, [*on, "_salt"]).drop("_salt")


PRIVATE = ["_none", "_source", "_key", "_size", "_weight", "_u"]


def _with_order(rows: DataFrame, mix: Mix) -> DataFrame:
    """Certain copies, the odds of one more, and the Pareto order: random odds divided by inclusion odds.

    ``_order`` is squeezed into (0, 1), which keeps its order; it is null where one more copy has no chance.
    """
    copies = F.least(F.lit(float(mix.cap)), F.coalesce(F.col("_rate") * F.col("_weight"), F.lit(0.0)))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_chance") / (1 - F.col("_chance")))
    return (rows.withColumn("_expected", copies)
            .withColumn("_whole", F.floor(F.col("_expected") + 1e-9))
            .withColumn("_chance", F.col("_expected") - F.col("_whole"))
            .withColumn("_order", F.when((F.col("_chance") > 1e-9) & (F.col("_size") > 0), odds / (1 + odds))))


def _round(rows: DataFrame, on: list[str], small: bool) -> DataFrame:
    """``(..., _bound, _filled)`` per source: rows up to the order ``_bound`` come to ``_filled`` words, ``_gap`` at most.

    The bound is found from a histogram of the order keys and then inside one of its cells, so no task sorts the
    rows of a source.
    """
    celled = rows.withColumn("_cell", F.floor(F.col("_order") * CELLS))
    in_order = Window.partitionBy(*on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = celled.groupBy(*on, "_cell").agg(F.sum("_size").alias("_words"), F.first("_gap").alias("_gap")).withColumn("_upto", F.sum("_words").over(in_order))
    fits = F.col("_upto") <= F.col("_gap")
    cut = cells.groupBy(*on).agg(F.min(F.when(~fits, F.col("_cell"))).alias("_cut"), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_before"))
    one_cell = Window.partitionBy(*on).orderBy("_order", "_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    inside = (_by_source(celled, cut, small).where("_cell = _cut").withColumn("_upto", F.col("_before") + F.sum("_size").over(one_cell)).where(fits)
              .groupBy(*on).agg(F.max("_order").alias("_last"), F.max("_upto").alias("_reached")))
    just_below = F.col("_cut") / F.lit(float(CELLS)) * F.lit(1 - 2.0 ** -53)
    return cut.join(inside, on, "left").select(
        *on, F.when(F.col("_cut").isNull(), F.lit(1.0)).otherwise(F.coalesce("_last", just_below)).alias("_bound"), F.coalesce("_reached", "_before").alias("_filled"))


def _taken(rounds: int) -> Column:
    """Whether one more copy is taken: in the first round any row up to its bound, later those that fit the gap left."""
    hit = F.lit(False)
    for r in range(rounds):
        reached = F.col("_order") <= F.col(f"_bound{r}")
        hit = hit | (reached & (F.col("_order") > F.col(f"_bound{r - 1}")) & (F.col("_size") <= F.col(f"_gap{r}")) if r else reached)
    return F.coalesce(hit, F.lit(False))


def plan_mix(measured: DataFrame, mix: Mix, broadcast_sources: int = BROADCAST_SOURCES) -> tuple[DataFrame, bool]:
    """One row a source: target, rate of copies, the bounds of each round, the closing row; and whether they are few enough to broadcast.

    Whole copies are certain; what is then missing to the target is filled with one more copy each in Pareto order
    until the next document would not fit.  Further rounds go on behind it with the documents that do fit, and the gap
    left at the end is closed by the one document that comes nearest to it.
    """
    on = ["_none", "_source"]
    slim = cut_lineage(measured.select(*PRIVATE))
    sums = slim.groupBy(*on).agg(F.sum(F.col("_size") * F.col("_weight")).alias("_mass"))
    targets = cut_lineage(source_targets(slim, mix).join(sums, on)
                          .withColumn("_rate", F.when(F.col("_mass") > 0, F.col("target") / F.col("_mass")).otherwise(F.lit(0.0))))
    small = targets.count() <= broadcast_sources
    certain = _with_order(_by_source(slim, targets, small), mix).groupBy(*on).agg(F.sum(F.col("_whole") * F.col("_size")).alias("_certain"))
    plan = cut_lineage(targets.join(certain, on).withColumn("_gap0", F.col("target") - F.col("_certain")).select(*on, "source_size", "target", "_rate", "_gap0"))
    for r in range(mix.rounds):
        rows = _with_order(_by_source(slim, plan, small), mix).where("_order is not null").withColumn("_gap", F.col(f"_gap{r}"))
        if r:
            rows = rows.where((F.col("_order") > F.col(f"_bound{r - 1}")) & (F.col("_size") <= F.col("_gap")))
        found = _round(rows.select(*on, "_key", "_size", "_u", "_order", "_gap"), on, small)
        plan = cut_lineage(plan.join(found, on, "left").withColumns({
            f"_bound{r}": F.coalesce("_bound", F.lit(1.0 if r else 0.0)), f"_gap{r + 1}": F.col(f"_gap{r}") - F.coalesce("_filled", F.lit(0))}).drop("_bound", "_filled"))
    gap = F.col(f"_gap{mix.rounds}")
    left = _with_order(_by_source(slim, plan, small), mix).where(F.col("_order").isNotNull() & ~_taken(mix.rounds)).withColumn("_miss", F.abs(gap - F.col("_size")))
    closing = left.where(F.col("_miss") < gap).groupBy(*on).agg(F.min(F.struct("_miss", "_order")).alias("_close"))
    return cut_lineage(plan.join(closing, on, "left").withColumn("_closing", F.col("_close._order")).drop("_close")), small


def mixed(docs: DataFrame, mix: Mix | None = None, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (words of its source) and ``copies``.

    The words taken from a source, size times copies, come as near to its target as its documents allow.  ``weight``
    names a column of relative inclusion weights within a source (null or negative: zero); without it all documents of
    a source have the same expected copies.  Draws depend on the row's key and text alone: reruns agree, and repeated rows
    share their fate.  Null texts have size 0 and get no fraction of a copy; a null source is a source; an empty table gives an
    empty result.  Columns named like the four results are replaced, all others pass through.
    """
    mix = mix or Mix()
    measured = _measured(docs, key, text, source, weight, mix)
    rows = _with_order(_by_source(measured, *plan_mix(measured, mix)), mix)
    more = _taken(mix.rounds) | F.coalesce(F.col("_order") == F.col("_closing"), F.lit(False))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return rows.select(*kept, F.col("_size").alias("size"), "source_size", "target", (F.col("_whole") + more.cast("long")).alias("copies"))

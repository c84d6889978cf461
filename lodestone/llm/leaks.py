"""Benchmark decontamination by template canonicalisation, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# fixed values: units that count as such right after a number
UNITS = ["%", "°", "$", "€", "£", "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "v", "w", "kw", "mb", "gb", "tb",
         "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "meter", "meters", "metre", "metres",
         "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "percent", "degree", "degrees", "cent", "cents", "dollar", "dollars", "euro", "euros"]


#: What tells a document apart: its key and the hash of its text.
DOC = ["doc_id", "doc_hash"]


@dataclass(frozen=True)
class Leaks:
    """Words in a window, part of an item's windows that makes a leak, words of a window that must be no placeholder,
    share of an occurrence's slots that may contradict each other, and the most benchmark windows to broadcast."""
    window: int = 5
    coverage: float = 0.8
    literal: int = 2
    conflicts: float = 0.1
    broadcast_rows: int = 1_000_000


def marked(text: Column) -> Column:
    """Words parted by single blanks, in lower case; names, numbers and units behind a number have their mark in front.

    A capital marks a name unless it begins a line or sentence; points within a number become ``_``.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[\p{Ll}\p{N},;:] .)[\p{L}\p{M}]*", NAME + "$0")
    out = F.regexp_replace(F.lower(out), r"(?<=[0-9])[.,:](?=[0-9])", "_")
    out = F.regexp_replace(out, r"(?<![a-z\p{L}\p{N}_])[0-9][0-9_]*", NUMBER + "$0 ")
    out = F.regexp_replace(out, r"[^a-z0-9_\x01-\x03%°$€£\p{L}\p{M}\p{N}]+", " ")
    return F.regexp_replace(out, f"({NUMBER}[^ ]* +)(" + "|".join("\\" + u if u in "$" else u for u in UNITS) + r")(?=[ \x01-\x03]|$)", "$1" + UNIT + "$2")


def template(words: Column) -> Column:
    """The marked text with bare marks instead of names, numbers and units."""
    return F.regexp_replace(words, r"([\x01-\x03])[^ ]+", "$1")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def _windows(made: Column, w: int) -> Column:
    """Hashes of all runs of ``w`` template words."""
    last = F.size(made) - w
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(made, i + 1, w), " "))))


def _all_windows(df: DataFrame, kept: list[str], w: int) -> DataFrame:
    """``kept`` columns of ``df``, ``pos``, ``hash``, ``tokens`` and ``templates`` of every window of ``_text``.

    Every window comes in two forms, with names as placeholders and as words: a copy may have lost its capitals.
    """
    laid = df.withColumn("_marked", marked(F.col("_text"))).select(
        *kept, _words(F.col("_marked")).alias("_raw"), F.explode(F.array(template(F.col("_marked")), template(nameless(F.col("_marked"))))).alias("_form"))
    cut = laid.select(*kept, "_raw", _words(F.col("_form")).alias("_made"))
    return (cut.select(*kept, "_raw", "_made", F.posexplode(_windows(F.col("_made"), w)).alias("pos", "hash"))
            .select(*kept, "pos", "hash", F.slice("_raw", F.col("pos") + 1, w).alias("tokens"), F.slice("_made", F.col("pos") + 1, w).alias("templates"))
            .dropDuplicates([*kept, "pos", "hash"]))


def nameless(words: Column) -> Column:
    """The marked text with names as plain words."""
    return F.replace(words, F.lit(NAME), F.lit(""))


def item_windows(items: DataFrame, cfg: Leaks, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, item_id, hash, item_pos, tokens, templates, same, n, need, rare)``: every window that is not mostly placeholders.

    ``item`` names an id with its text: rows that share an id, or have none, are items of their own unless their texts are equal.
    Windows count in stretches of ``need`` consecutive ones: ``cfg.window`` of them, or one where an item has no such
    stretch; shorter stretches are left out.  ``same`` names a window whatever its form, ``n`` counts the distinct ones.
    ``rare`` marks the windows that the fewest items share, one more than a leak may miss, so every leak holds one.
    """
    w = cfg.window
    named = items.select(F.xxhash64(F.col(key).isNull(), key, F.col(text)).alias("item"), F.col(key).alias("item_id"), F.col(text).alias("_text"))
    laid = (_all_windows(named, ["item", "item_id"], w).withColumnRenamed("pos", "item_pos")
            .where(F.size(F.filter("templates", lambda x: ~F.substring(x, 1, 1).isin(NAME, NUMBER, UNIT))) >= cfg.literal)
            .withColumn("same", F.xxhash64(F.array_join(F.transform("tokens", lambda x: F.regexp_replace(x, r"^[\x01-\x03]", "")), " "))))
    run = F.col("item_pos") - F.dense_rank().over(Window.partitionBy("item").orderBy("item_pos"))
    long = F.count_distinct("item_pos") >= w
    runs = laid.withColumn("_run", run)
    lengths = runs.groupBy("item", "_run").agg(long.alias("_long"))
    needs = lengths.groupBy("item").agg(F.when(F.max("_long"), w).otherwise(1).alias("need"))
    laid = runs.join(lengths, ["item", "_run"]).join(needs, "item").where(F.col("_long") | (F.col("need") == 1)).drop("_run", "_long")
    shared = laid.groupBy("hash").agg(F.count_distinct("item").alias("_items"))
    one = laid.join(shared, "hash").groupBy("item", "same").agg(F.max("_items").alias("_items"))
    order = F.row_number().over(Window.partitionBy("item").orderBy("_items", "same"))
    n = F.count("*").over(Window.partitionBy("item"))
    rare = one.withColumn("n", n).withColumn("rare", order <= F.col("n") - F.ceil(F.col("n") * cfg.coverage - 1e-9) + 1).drop("_items")
    return laid.join(rare, ["item", "same"]).select("item", "item_id", "hash", "item_pos", "tokens", "templates", "same", "n", "need", "rare")


def _touched(docs: DataFrame, known: DataFrame, near, cfg: Leaks) -> DataFrame:
    """The ``DOC`` columns of documents with a window of some item at every ``cfg.window``-th place.

    A stretch of that many windows holds one of them, so this misses no leak of an item that asks for such a stretch; the
    windows of shorter items are looked for at every place.
    """
    word, w = "[^ ]+", cfg.window
    text = docs.select(*DOC, marked(F.col("_text")).alias("_marked")).select(*DOC, template(F.col("_marked")).alias("_made"), template(nameless(F.col("_marked"))).alias("_plain"))

    def hits(pattern: str, group: int, wanted: DataFrame) -> DataFrame:
        found = F.concat(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(group)) for c in ("_made", "_plain")])
        return text.select(*DOC, F.explode(found).alias("_w")).select(*DOC, F.xxhash64("_w").alias("hash")).join(near(wanted.select("hash").distinct()), "hash", "left_semi").select(*DOC)

    out = hits(f"{word}(?: {word}){{{w - 1}}}", 0, known)
    short = known.where(F.col("need") < w)
    if not short.isEmpty():
        out = out.union(hits(f"(?<![^ ])(?=({word}(?: {word}){{{w - 1}}}))", 1, short))
    return out.distinct()


def _same_doc(left: str = "", right: str = "_") -> Column:
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}doc_hash") == F.col(f"{right}doc_hash"))


def _away(df: DataFrame, names: list[str]) -> DataFrame:
    """The same columns, those of ``names`` with a stroke in front, for joins on nullable keys."""
    return df.withColumnsRenamed({c: f"_{c}" for c in names})


def text_hash(text: Column) -> Column:
    """Null texts have the hash of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leaks(docs: DataFrame, items: DataFrame, cfg: Leaks | None = None, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, doc_hash, item_id, n_windows, matched, coverage, slots, changed)`` for each document that holds an item.

    Both sides are cut into words whose numbers, units and names become typed placeholders, and windows of template words
    meet in a hash join, with names as placeholders or as words; they count in stretches of ``cfg.window`` consecutive ones.  Per occurrence (one offset between document and item) each value of the item must stand for one
    value in the document; an occurrence with more contradictions than ``cfg.conflicts`` of its slots does not count.  An
    item leaks where ``cfg.coverage`` of its distinct windows are found.  ``changed`` counts slots with another value:
    more than zero means a re-parameterised question.

    A document is a key and a text: rows that share a key, or have none, are judged apart unless their texts are equal, and
    ``doc_hash`` tells them apart.  The same holds for items.  Null, empty and short texts hold no window and leak
    nothing.  Repeated rows change nothing; other columns are ignored; an empty side gives an empty result.  A text wholly in capitals
    is read as names and finds only items written so.
    """
    cfg = cfg or Leaks()
    w = cfg.window
    known = cut_lineage(item_windows(items, cfg, item_key, item_text))
    small = known.count() <= cfg.broadcast_rows
    near = F.broadcast if small else (lambda side: side)  # a checked size; beyond it both sides are shuffled
    texts = docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("doc_hash"), F.col(text).alias("_text"))
    touched = cut_lineage(_touched(texts, known, near, cfg)).transform(_away, DOC)
    held = texts.join(touched, _same_doc(), "left_semi")
    placed = cut_lineage(_all_windows(held, DOC, w).withColumnsRenamed({"pos": "doc_pos", "tokens": "doc_tokens"}).drop("templates")
                         .join(near(known.select("hash").distinct()), "hash", "left_semi"))
    pairs = placed.join(near(known.where("rare").select("item", "hash").distinct()), "hash").select(*DOC, "item").distinct().transform(_away, [*DOC, "item"])
    met = placed.join(near(known), "hash").join(pairs, _same_doc() & (F.col("item") == F.col("_item")), "left_semi")
    here = [*DOC, "item", "offset"]
    met = met.withColumn("offset", F.col("doc_pos") - F.col("item_pos")).dropDuplicates([*here, "item_pos", "doc_tokens", "templates"])
    # stretches of consecutive windows at one offset
    run = F.col("item_pos") - F.dense_rank().over(Window.partitionBy(*here).orderBy("item_pos"))
    met = met.withColumn("_run", run)
    met = met.withColumn("_length", F.max("item_pos").over(Window.partitionBy(*here, "_run")) - F.min("item_pos").over(Window.partitionBy(*here, "_run")) + 1).where("_length >= need")

    slot = F.explode(F.filter(F.arrays_zip("templates", "tokens", "doc_tokens"), lambda s: s["templates"].isin(NAME, NUMBER, UNIT)))
    values = (met.select(*here, slot.alias("s")).groupBy(*here, "s.templates", F.col("s.tokens").alias("theirs"))
              .agg(F.count_distinct("s.doc_tokens").alias("values"), F.max((F.col("s.doc_tokens") != F.col("s.tokens")).cast("long")).alias("changed")))
    slots = values.groupBy(*here).agg(F.count("*").alias("slots"), F.sum((F.col("values") > 1).cast("long")).alias("conflicts"), F.sum("changed").alias("changed"))
    matched = met.select(*here, "item_id", "n", "same").distinct().join(slots.transform(_away, here), _same_doc() & (F.col("item") == F.col("_item")) & (F.col("offset") == F.col("_offset")), "left")
    fine = matched.where(F.coalesce(F.col("conflicts") <= F.col("slots") * cfg.conflicts, F.lit(True)))
    return (fine.groupBy(*DOC, "item", "item_id")
            .agg(F.max("n").alias("n_windows"), F.count_distinct("same").alias("matched"),
                 F.coalesce(F.max("slots"), F.lit(0)).alias("slots"), F.coalesce(F.max("changed"), F.lit(0)).alias("changed"))
            .withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= cfg.coverage)
            .select(*DOC, "item_id", "n_windows", "matched", "coverage", "slots", "changed"))


def without_leaks(docs: DataFrame, items: DataFrame, cfg: Leaks | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, unchanged; rows that share a key, or have none, do not go for one another."""
    gone = leaks(docs, items, cfg, key, text).select(F.col("doc_id").alias("_gone"), F.col("doc_hash").alias("_gone_hash")).distinct()
    return docs.join(gone, F.col(key).eqNullSafe(F.col("_gone")) & (text_hash(F.col(text)) == F.col("_gone_hash")), "left_anti")

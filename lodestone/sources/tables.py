"""Index rows and row-level maintenance of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, stack


def _first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def build_index_rows(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with what they lack filled in from their parents; an empty string counts as lacking."""
    shared = ["parent_doc_id", "source_type", "doc_semantic_type", "title", "section_heading"]
    side = parents.select("parent_chunk_id", *[F.col(c).alias(f"p_{c}") for c in shared],
                          F.col("text").alias("p_text"), F.lit(True).alias("p_found"))
    joined = children.join(side, "parent_chunk_id", "left")

    def ordinal(name: str) -> Column:
        value = F.col(name) if name in children.columns else F.lit(None)
        return F.coalesce(value.cast("int"), F.lit(0)).alias(name)

    own_text = F.coalesce("text", F.lit(""))
    filled = [_first_given(F.col(c), F.col(f"p_{c}")).alias(c) for c in shared if c != "doc_semantic_type"]
    kind = F.coalesce(F.nullif("doc_semantic_type", F.lit("")), F.nullif("p_doc_semantic_type", F.lit("")),
                      F.lit("generic_doc")).alias("doc_semantic_type")
    embedding = [F.col("embedding")] if "embedding" in children.columns else []
    return joined.select(
        "chunk_id", F.coalesce("parent_chunk_id", F.lit("")).alias("parent_chunk_id"), *filled, kind,
        own_text.alias("child_text"),
        F.when(F.col("p_found"), F.coalesce("p_text", own_text)).otherwise(own_text).alias("parent_text"),
        ordinal("chunk_index"), ordinal("parent_chunk_index"), ordinal("child_chunk_index"), *embedding)


def upsert_rows(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Incoming rows replace existing ones of the same key; of several incoming the last by ``order``."""
    latest = incoming
    if order is not None:
        whole = F.struct(*incoming.columns)
        latest = incoming.groupBy(F.col(key).alias("_key")).agg(
            F.max_by(whole, order).alias("row")).select("row.*")
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.transform(stack, latest)


def numbered(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Add ``position``: 0-based place in the order of a unique key, without a single-task window.

    A range-partitioned sort is written once, so that places cannot change between the count of its
    partitions and their rows; each row then adds its place inside its partition to the rows before it.
    """
    keys = [key] if isinstance(key, str) else key
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_place", F.monotonically_increasing_id())
    stored = cut_lineage(ordered).withColumn("_part", F.shiftright("_place", 33))
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return stored.join(F.broadcast(before), "_part").withColumn(
        "position", F.col("_before") + inside).drop("_part", "_place", "_before")


def contiguous_part(df: DataFrame, n_parts: int, part: int, key: str | list[str]) -> DataFrame:
    """The part-th (1-based) of n contiguous parts of ceil(total / n) rows in key order."""
    if n_parts <= 0:
        raise ValueError("the number of parts must be positive")
    if not 1 <= part <= n_parts:
        raise ValueError("the part must lie between 1 and the number of parts")
    rows = numbered(df, key)
    size = rows.agg(F.ceil(F.count("*") / n_parts).alias("n")).scalar()
    return rows.filter((F.col("position") >= (part - 1) * size) & (F.col("position") < part * size))


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; where it is unknown the row stays."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))

"""Public search results as rows, and their place among the sources of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.ranking import with_rank
from lodestone.session import stack


def _first_of(df: DataFrame, names: list[str]) -> Column:
    given = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return strip(F.coalesce(*given, F.lit("")))


def normalize_web_results(raw: DataFrame, k: int) -> DataFrame:
    """Title, url and snippet from the names providers use; the first k usable results per query.

    Rows without url and snippet, and rows whose score is no number within 0..1, are dropped.
    """
    score = F.coalesce(F.col("score").cast("string"), F.lit("0")) if "score" in raw.columns else F.lit("0")
    provider = F.coalesce(F.nullif("provider", F.lit("")), F.lit("web")) if "provider" in raw.columns else F.lit("web")
    rows = raw.select(
        "query_id", "position", _first_of(raw, ["title", "name"]).alias("title"),
        _first_of(raw, ["url", "link"]).alias("url"),
        _first_of(raw, ["snippet", "content", "description"]).alias("snippet"),
        F.when(score == "", 0.0).otherwise(score.try_cast("double")).alias("score"), provider.alias("provider"))
    usable = rows.filter(((F.col("url") != "") | (F.col("snippet") != "")) & F.col("score").between(0.0, 1.0))
    return with_rank(usable, [F.col("position")]).filter(F.col("rank") <= k)


def merge_sources(internal: DataFrame, web: DataFrame) -> DataFrame:
    """Internal sources in their order, then web results: ``(query_id, position, source_id, title, source_type)``."""
    url, title = F.nullif("url", F.lit("")), F.nullif("title", F.lit(""))
    inside = internal.select("query_id", F.lit(0).alias("block"), F.col("rank").cast("bigint").alias("rank"),
                             "source_id", "title", "source_type")
    outside = web.select(
        "query_id", F.lit(1).alias("block"), F.col("rank").cast("bigint").alias("rank"),
        F.concat(F.lit("web:"), F.coalesce(url, title, F.lit("result"))).alias("source_id"),
        F.coalesce(title, url, F.lit("Web reference")).alias("title"), F.lit("web_reference").alias("source_type"))
    return with_rank(inside.transform(stack, outside), [F.col("block"), F.col("rank"), F.col("source_id")],
                     name="position").drop("block", "rank")

"""Metadata filters, phrase matches, boosts and access control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import normalize_name

LISTS = ("source_types", "doc_semantic_types", "title_keywords", "section_keywords")


def padded(text: Column) -> Column:
    """Analysed tokens between single blanks."""
    return F.concat(F.lit(" "), normalize_name(F.coalesce(text, F.lit(""))), F.lit(" "))


def _given(values: Column) -> Column:
    """A list without nulls and blanks; null counts as empty."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def phrase_match(text: Column, phrases: Column) -> Column:
    """True where any of the phrases occurs as consecutive tokens of the text."""
    whole = padded(text)
    return F.exists(_given(phrases), lambda phrase: whole.contains(padded(phrase)))


def allowed_by(decision: dict[str, Column], row: dict[str, Column]) -> Column:
    """A row passes a hard decision: every list that is given must match; other modes let all pass."""
    sources, kinds = _given(decision["source_types"]), _given(decision["doc_semantic_types"])
    titles, sections = _given(decision["title_keywords"]), _given(decision["section_keywords"])
    passes = ((F.size(sources) == 0) | F.coalesce(F.array_contains(sources, row["source_type"]), F.lit(False)))
    passes &= (F.size(kinds) == 0) | F.coalesce(F.array_contains(kinds, row["doc_semantic_type"]), F.lit(False))
    passes &= (F.size(titles) == 0) | phrase_match(row["title"], titles)
    passes &= (F.size(sections) == 0) | phrase_match(row["section_heading"], sections)
    return (F.coalesce(decision["mode"], F.lit("none")) != "hard") | passes


def hard_filter(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keep the rows their query's decision admits.  Apply it to scored rows before the cut to k.

    ``rows`` has query_id and the attributes; ``decisions(query_id, mode, source_types, ...)``.
    """
    side = decisions.select("query_id", F.col("mode").alias("_mode"), *[F.col(c).alias(f"_{c}") for c in LISTS])
    joined = rows.join(side, "query_id", "left")
    decision = {"mode": F.col("_mode"), **{c: F.col(f"_{c}") for c in LISTS}}
    row = {c: F.col(c) for c in ("source_type", "doc_semantic_type", "title", "section_heading")}
    return joined.filter(allowed_by(decision, row)).select(*rows.columns)


def filter_by_source(rows: DataFrame, source_type: str) -> DataFrame:
    return rows.filter(F.col("source_type") == source_type)


def dense_filters(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Give each query the lists that ``knn_exact`` applies while it scores; an empty list is no test."""
    side = decisions.filter("mode = 'hard'").select("query_id", *[_given(F.col(c)).alias(f"_{c}") for c in LISTS])
    joined = queries.join(side, "query_id", "left")
    return joined.select(
        *queries.columns, F.col("_source_types").alias("allowed_sources"), F.col("_doc_semantic_types").alias("allowed_kinds"),
        F.transform("_title_keywords", padded).alias("title_phrases"),
        F.transform("_section_keywords", padded).alias("section_phrases"))


def dense_attributes(rows: DataFrame) -> DataFrame:
    """The columns of vectors that ``dense_filters`` is matched against."""
    return rows.withColumn("section", padded(F.col("section_heading"))).withColumn("title", padded(F.col("title")))


def _boosted(rows: DataFrame, matches: Column, boost: float, keep: list[str]) -> DataFrame:
    factor = F.when(F.coalesce(matches, F.lit(False)), 1.0 + boost).otherwise(1.0)
    return rows.withColumn("score", F.round(F.col("score") * factor, 9)).select(*keep)


def boost_sources(fused: DataFrame, hints: DataFrame, boost: float = model.SOFT_BOOST) -> DataFrame:
    """Multiply the score where the source is among the query's hints.  ``hints(query_id, source_hints)``."""
    joined = fused.join(hints.select("query_id", "source_hints"), "query_id", "left")
    return _boosted(joined, F.array_contains(_given(F.col("source_hints")), F.col("source_type")), boost, fused.columns)


def soft_boost(fused: DataFrame, decisions: DataFrame, boost: float = model.SOFT_BOOST) -> DataFrame:
    """Multiply the score once where a hint, or in soft mode any part of the decision, matches.

    Keywords match as substrings of the lower-cased title or heading.
    """
    side = decisions.select("query_id", F.col("mode").alias("_mode"), _given(F.col("source_hints")).alias("_hints"),
                            *[_given(F.col(c)).alias(f"_{c}") for c in LISTS])
    joined = fused.join(side, "query_id", "left")

    def found(text: str, words: str) -> Column:
        lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
        return F.exists(words, lambda word: lowered.contains(F.lower(word)))

    soft = (F.array_contains("_source_types", F.col("source_type"))
            | F.array_contains("_doc_semantic_types", F.col("doc_semantic_type"))
            | found("title", "_title_keywords") | found("section_heading", "_section_keywords"))
    matches = (F.coalesce(F.array_contains("_hints", F.col("source_type")), F.lit(False))
               | (F.coalesce(F.col("_mode") == "soft", F.lit(False)) & F.coalesce(soft, F.lit(False))))
    return _boosted(joined, matches, boost, fused.columns)


def acl_filter(rows: DataFrame, queries: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows a query's user may see: own ones, public ones, those of a granted knowledge base.

    ``rows(query_id, item_id, owner_user_id, knowledge_base_id, visibility, ...)``, ``queries(query_id,
    user_id)``, ``grants(user_id, knowledge_base_id)``.  Apply it before search and again to what is fused,
    reranked and cited.
    """
    users = queries.select("query_id", "user_id")
    granted = grants.select("user_id", "knowledge_base_id").distinct().withColumn("_granted", F.lit(True))
    joined = rows.join(users, "query_id", "left").join(granted, ["user_id", "knowledge_base_id"], "left")
    sees = ((F.col("owner_user_id") == F.col("user_id")) | (F.col("visibility") == "enterprise_public")
            | F.col("_granted"))
    return joined.filter(F.coalesce(sees, F.lit(False))).select(*rows.columns)


def acl_removed_all(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries that had candidates and lost every one to access control."""
    return before.select("query_id").distinct().join(after.select("query_id"), "query_id", "left_anti")

"""Tokens of the two lexical indexes and of the entity matcher."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import normalize_name


def tokenize(text: Column, mode: str = "child") -> Column:
    """``child`` and ``parent`` keep repeats (parent adds single CJK characters); ``entity`` does not."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if mode == "child":
        return F.regexp_extract_all(lowered, F.lit(f"({model.CHILD_TOKEN})"), F.lit(1))
    if mode == "parent":
        latin = F.regexp_extract_all(lowered, F.lit(f"({model.PARENT_TOKEN})"), F.lit(1))
        cjk = F.regexp_extract_all(lowered, F.lit(f"({model.CJK_CHARACTER})"), F.lit(1))
        return F.concat(latin, cjk)
    if mode == "entity":
        words = F.split(normalize_name(F.coalesce(text, F.lit(""))), " ")
        return F.array_distinct(F.filter(words, lambda word: word != ""))
    raise ValueError(f"unknown token mode: {mode}")


def keywords(text: Column) -> Column:
    """Words of at least two characters, split at blanks and CJK or ASCII punctuation."""
    parts = F.split(F.coalesce(text, F.lit("")), r"""(?U)[\s,，。！？；;:：、/\\|()\[\]{}<>《》"']+""")
    return F.filter(parts, lambda part: F.length(part) >= 2)


def terms_hit(text: Column, terms: Column) -> Column:
    """Every term occurs in the text, case and blanks ignored; no terms is a hit."""
    def squeeze(value: Column) -> Column:
        return F.translate(F.lower(value), " ", "")

    return F.forall(terms, lambda term: squeeze(F.coalesce(text, F.lit(""))).contains(squeeze(term)))

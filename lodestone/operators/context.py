"""What an answer is given and what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.memory import sanitize_memory, sanitize_type
from lodestone.operators.ranking import with_rank

# The layout of context blocks.
DOCUMENT_BLOCK = ["【资料%d】", "source_type: ", "doc_semantic_type: ", "title: ", "section: ", "parent_doc_id: ", "content:"]
EMPTY_WEB = "无。"
EMPTY_MEMORY = "无"


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _joined(rows: DataFrame, block: Column, separator: str, name: str) -> DataFrame:
    """Blocks of a query in rank order; a query has no more than its final k of them."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda b: b["block"]), separator).alias(name))


def pack_context(selected: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``(query_id, context)``: numbered blocks of the selected documents, texts cut to ``max_chars`` if given."""
    title, source, kind, name, section, doc, content = DOCUMENT_BLOCK
    block = F.concat_ws(
        "\n", F.format_string(title, F.col("rank").cast("int")), F.concat(F.lit(source), _text("source_type")),
        F.concat(F.lit(kind), _text("doc_semantic_type")), F.concat(F.lit(name), _text("title")),
        F.concat(F.lit(section), _text("section_heading")), F.concat(F.lit(doc), _text("parent_doc_id")),
        F.lit(content), _cut(_text("text"), max_chars))
    return _joined(selected, block, "\n\n", "context")


def pack_web(results: DataFrame) -> DataFrame:
    """``(query_id, web_context)`` of web results; queries without any get the empty marker from the caller."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Web reference"))
    block = F.concat(F.format_string("[%d] ", F.col("rank").cast("int")), title, F.lit("\nURL: "), _text("url"),
                     F.lit("\n摘要: "), _text("snippet"))
    return _joined(results, block, "\n\n", "web_context")


def pack_memories(recalled: DataFrame, most: int | None = None) -> DataFrame:
    """``(query_id, memory_context)``: the memories, or the ``most`` first, that are not blank, sanitised and numbered."""
    line = F.concat(F.format_string("%d. [", F.col("rank").cast("int")), sanitize_type(F.col("category")), F.lit("] "),
                    sanitize_memory(F.col("memory")))
    head = (recalled if most is None else recalled.filter(F.col("rank") <= most)).filter(sanitize_memory(F.col("memory")) != "")
    return _joined(head, line, "\n", "memory_context")


def answer_sources(selected: DataFrame, most: int | None = None, max_snippet: int | None = None) -> DataFrame:
    """The sources of a query, or the ``most`` first, named by chunk, document or title, with a snippet of their text."""
    name = F.coalesce(F.nullif("parent_chunk_id", F.lit("")), F.nullif("parent_doc_id", F.lit("")),
                      F.nullif("title", F.lit("")), F.lit("source"))
    ranked = with_rank(selected, [F.col("rank")], name="position")
    ranked = ranked if most is None else ranked.filter(F.col("position") <= most)
    return ranked.select("query_id", "position", name.alias("source_id"), "parent_doc_id", "parent_chunk_id", "title",
                         _cut(_text("text"), max_snippet).alias("snippet"))

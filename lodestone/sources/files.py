"""Reading corpora, questions, JSON lines and text files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import clean_text, normalize_list
from lodestone.session import stack

def scan_documents(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """The four document columns and no others; ``names`` maps them to other column names."""
    names = names or {}
    columns = [F.col(names.get(c, c)).cast("string").alias(c) for c in ("doc_id", "source_type", "title", "content")]
    return spark.read.parquet(path).select(*columns)


def normalize_questions(raw: DataFrame) -> DataFrame:
    """Clean the texts and make every list column a list; missing columns become empty."""
    types = dict(raw.dtypes)

    def text(name: str) -> Column:
        return clean_text(F.col(name) if name in types else F.lit(None))

    def listed(name: str) -> Column:
        if name not in types:
            return F.array().cast("array<string>")
        return normalize_list(F.col(name), types[name].startswith("array"))

    plain = [F.col(c).cast("string").alias(c) if c in types else F.lit(None).cast("string").alias(c)
             for c in ("question_id", "question_type")]
    return raw.select(*plain, listed("source_types").alias("source_types"), text("question").alias("question"),
                      listed("expected_doc_ids").alias("expected_doc_ids"), text("gold_answer").alias("gold_answer"),
                      listed("answer_facts").alias("answer_facts"))


def scan_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions and the distinct document ids they expect."""
    questions = normalize_questions(spark.read.parquet(path))
    return questions, expected_ids(questions)


def expected_ids(questions: DataFrame) -> DataFrame:
    return questions.select(F.explode("expected_doc_ids").alias("doc_id")).distinct()


def scan_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One object per line with a given schema; blank lines are skipped.  ``limit`` takes the smallest by the first column."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.orderBy(*rows.columns[:1]).limit(limit)


def clean_groups(groups: Column) -> Column:
    """Evidence groups without nulls, blanks and empty groups; ids trimmed."""
    trimmed = F.transform(groups, lambda group: F.filter(
        F.transform(group, lambda item: F.regexp_replace(item.cast("string"), r"(?U)^\s+|\s+$", "")),
        lambda item: item.isNotNull() & (item != "")))
    kept = F.filter(trimmed, lambda group: F.coalesce(F.size(group), F.lit(0)) > 0)
    return F.coalesce(kept, F.array().cast("array<array<string>>"))


def load_questions_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions of an evaluation file: missing lists become empty, evidence groups are cleaned.

    Groups are read as variants first, so that a group that is no list is dropped, not an error.
    """
    loose = model.QUESTIONS.replace("required_evidence_groups array<array<string>>",
                                    "required_evidence_groups variant")
    rows = scan_jsonl(spark, path, loose, limit)
    as_groups = F.transform(F.try_variant_get("required_evidence_groups", "$", "array<variant>"),
                            lambda group: F.try_variant_get(group, "$", "array<string>"))
    empty = F.array().cast("array<string>")
    return rows.select(
        "question_id", F.coalesce("question_type", F.lit("")).alias("question_type"),
        F.coalesce("source_types", empty).alias("source_types"), "question",
        F.coalesce("expected_doc_ids", empty).alias("expected_doc_ids"),
        F.coalesce("gold_answer", F.lit("")).alias("gold_answer"),
        F.coalesce("answer_facts", empty).alias("answer_facts"),
        clean_groups(as_groups).alias("required_evidence_groups"))


def _decode_gbk():
    def decode(contents: pd.Series) -> pd.Series:
        def one(content):
            try:
                return None if content is None else bytes(content).decode("gbk")
            except UnicodeDecodeError:
                return None

        return contents.map(one)

    return F.pandas_udf(decode, "string")


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else GBK, else null.  Only invalid UTF-8 reaches Python."""
    is_utf8 = F.is_valid_utf8(content.cast("string"))
    doubtful = F.when(~is_utf8, content)
    return F.when(is_utf8, F.decode(content, "UTF-8")).otherwise(_decode_gbk()(doubtful))


def scan_text_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md"),
                    file_cap: int | None = None, batch_cap: int | None = None) -> DataFrame:
    """``(path, content, text, status)``: a row for each of the allowed files under a folder.

    ``status`` is ``read``, ``not_text`` where the bytes are neither UTF-8 nor GBK, or ``too_large`` for a file over
    ``file_cap`` bytes, which is judged by its listed size and not read.  A folder whose files under the cap come to more than
    ``batch_cap`` bytes is an error, as it is at the upload endpoint.  Both caps are off unless given.  A file of no
    bytes gives no row, since the scan itself leaves it out.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder))
    small = listed if file_cap is None else listed.filter(F.col("length") <= file_cap)
    if batch_cap is not None:
        total = small.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).scalar()
        message = F.lit(f"upload batch is larger than {batch_cap} bytes")
        small = small.filter(F.when(total > batch_cap, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    decoded = small.select("path", "content", decode_text(F.col("content")).alias("text"))
    read = decoded.withColumn("status", F.when(F.col("text").isNull(), "not_text").otherwise("read"))
    if file_cap is None:
        return read
    large = listed.filter(F.col("length") > file_cap).select(
        "path", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("status"))
    return stack(read, large)


def ingest_new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content is new: ``(md5, path, status, text)``; status is ``loaded`` or ``empty``.

    Copies are grouped by digest before the registry is asked, so a content with many copies costs one row.
    The first path of a content stands for it.  Files without content (see the status of ``scan_text_files``) are passed
    over.  Register only what was loaded (``to_register``).
    """
    files = files.filter("text IS NOT NULL")
    digested = files.select(F.md5("content").alias("md5"), "path")
    first = digested.groupBy("md5").agg(F.min("path").alias("path"))
    new = first.join(registry.select("md5"), "md5", "left_anti")
    status = F.when(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") == "", "empty").otherwise("loaded")
    return files.select("path", "text").join(new, "path").select("md5", "path", status.alias("status"), "text")


def to_register(ingested: DataFrame) -> DataFrame:
    return ingested.filter("status = 'loaded'").select("md5")


def scan_parent_texts(parents: DataFrame) -> DataFrame:
    """``(parent_chunk_id, text)``, the last row of an id wins."""
    return parents.groupBy("parent_chunk_id").agg(
        F.coalesce(F.max_by("text", "parent_chunk_index"), F.lit("")).alias("text"))


def doc_type_lookup(parents: DataFrame) -> DataFrame:
    """``(parent_doc_id, doc_semantic_type)`` of the last chunk of each document."""
    kind = F.coalesce(F.nullif("doc_semantic_type", F.lit("")), F.lit("generic_doc"))
    known = parents.filter(F.coalesce("parent_doc_id", F.lit("")) != "")
    return known.groupBy("parent_doc_id").agg(
        F.max_by(kind, F.struct("parent_chunk_index", "parent_chunk_id")).alias("doc_semantic_type"))



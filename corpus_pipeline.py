"""A corpus from raw documents to a training mix: quality, near-duplicates, benchmark leaks, secrets, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import leaks, mixing, quality, secrets, simhash
from lodestone.session import cut_lineage, stack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[secret]"


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; labels of the held-out fifth are never read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.scored(docs.select(*COLUMNS), ensemble, name="_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, then with the smallest hash of its text.

    Documents are alike from a similarity of 0.8 of their five-word shingles on.  Rows are told apart by id and text, so rows that
    share an id, or have none, stay if their texts are not alike.  A row without an id stays only where its group has no
    other; of rows equal in both, that with the smallest other columns stays.
    """
    docs = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    groups = cut_lineage(simhash.similar_groups(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("_row"), F.count("*").alias("_rows"))
    first = first.select(F.col("_row.doc_id").alias("_id"), F.col("_row.text_hash").alias("_text"), (F.col("_rows") > 1).alias("_many"))
    kept = cut_lineage(docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))))
    least = kept.where("_many").groupBy("_id", "_text").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return stack(kept.where("NOT _many").select(*COLUMNS), least)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark."""
    cleaned = secrets.secret_spans(docs.select(*COLUMNS), name="_spans", redact=MARK).drop("_spans")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document it takes with its copies, the words they come to and its source's target."""
    found = mixing.mixed(docs.select(*COLUMNS)).where("copies > 0")
    return found.withColumn("taken", F.col("size") * F.col("copies"))


STAGES = [
    ("quality classifier", by_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and SimHash groups are beyond SQL; the tests hold each stage against a plain form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

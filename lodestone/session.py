"""Session helpers: a tuned session for local runs, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Set by local sessions only: partitions into which the registered queries deal long texts after a scan.
SCAN_PARTITIONS = "lodestone.scan.partitions"


def local_session(cores: str = "*", app: str = "lodestone", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(SCAN_PARTITIONS, str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def guard_unions(spark: SparkSession) -> None:
    """Switch off the claim of a union to be partitioned like its children.

    In Spark 4.1 the claim does not hold once adaptive execution coalesces the children differently: a
    following aggregation then skips its shuffle and leaves equal keys apart.  Results come before the saved
    shuffle.
    """
    spark.conf.set(UNION_PARTITIONING, "false")


BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def guard_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that reach Python.

    Bounded by rows alone, a batch of long texts and all that a task derives from it grow with the rows a task has, up to
    10 000 texts at once.
    """
    for name, value in BATCH_BYTES.items():
        spark.conf.set(name, value)


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both relations, columns matched by name."""
    guard_unions(first.sparkSession)
    return first.unionByName(second)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a local test without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a relation to the shared folder and read it back.

    Later stages then read the columns they need from files, whichever executors are lost.
    """
    path = f"{shared_folder(df.sparkSession)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

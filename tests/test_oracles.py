"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
# seven profiles in one plan; g17's two entries are made of the same rows
SLOW = {"c14_run_profile_grid"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, db, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(ours) > 0
        return
    left, right = canonical(ours), canonical(db.execute(sql).df())
    assert list(left.columns) == list(right.columns)
    assert left.equals(right)


@pytest.mark.parametrize("name", ["s01_stream_ingest", "s02_stream_pair_turns", "s05_stream_stage_latency", "s06_stream_new_memories", "s06_stream_new_memories_by_meaning"])
def test_streams_read_tables_that_are_folders(spark, db, tmp_path, name):
    for table in ("documents", "conversations", "embeddings", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    left, right = canonical(entry.queries()[name](spark, str(tmp_path)).toPandas()), canonical(db.execute(entry.oracle_sql()[name]).df())
    assert len(left) > 0 and left.equals(right)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

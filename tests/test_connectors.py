"""Connectors as formats: partitions, pushed marks, and streams that start again."""

import datetime as dt
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.sources import connectors

KINDS = "id string, name string, modified_at timestamp_ntz"
T = lambda n: dt.datetime(2024, 1, n)


def memory(rows, name="harbour"):
    return connectors.MemoryConnector(name, {"ships": (KINDS, rows)}, parts=3)


ROWS = [(str(i), f"ship {i}", T(1 + i % 9) if i % 5 else None) for i in range(40)]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_pull_reads_in_partitions_and_keeps_rows_without_a_time(spark):
    all_rows = connectors.pulled(spark, memory(ROWS), "ships", "acme")
    assert all_rows.columns == ["id", "name", "modified_at", "company"] and all_rows.rdd.getNumPartitions() == 3
    assert ids(all_rows) == sorted(r[0] for r in ROWS)
    some = connectors.pulled(spark, memory(ROWS), "ships", "acme", "2024-01-05T00:00:00")
    assert ids(some) == sorted(r[0] for r in ROWS if r[2] is None or r[2] > T(5))


def test_filters_on_the_time_of_change_are_pushed(spark):
    rows = connectors.pulled(spark, memory(ROWS), "ships", "acme")
    at = F.col("modified_at")
    some = rows.where((at > F.lit(T(4))) & (at <= F.lit(T(7))) & (F.col("name") != "ship 3"))
    assert ids(some) == sorted(r[0] for r in ROWS if r[2] and T(4) < r[2] <= T(7) and r[1] != "ship 3")
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter" in line and "modified_at" in line and "Scan" not in line]
    assert not left and "name" in plan
    assert ids(rows.where(at.isNull())) == sorted(r[0] for r in ROWS if r[2] is None)


def test_unknown_entities_and_systems_that_fail(spark):
    name = connectors.registered(spark, memory(ROWS))
    with pytest.raises(Exception, match="unknown entity"):
        spark.read.format(name).option("entity", "cargo").load()

    class Broken(connectors.MemoryConnector):
        def rows(self, *_):
            raise OSError("line is down")

    with pytest.raises(Exception, match="line is down"):
        connectors.pulled(spark, Broken("broken", {"ships": (KINDS, ROWS)}), "ships", "acme").collect()


def test_a_stream_that_starts_again_reads_each_row_once(spark, tmp_path):
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    rows = [r for r in ROWS if r[2]]
    read = lambda: Counter(tuple(r) for r in spark.read.schema(KINDS).parquet(path).collect())
    connectors.changes_into(spark, memory([r for r in ROWS if r[2] is None or r[2] <= T(4)]), "ships", path, checkpoint)
    assert read() == Counter(r for r in rows if r[2] <= T(4))
    connectors.changes_into(spark, memory(ROWS), "ships", path, checkpoint)
    assert read() == Counter(rows)
    connectors.changes_into(spark, memory(ROWS), "ships", path, checkpoint)  # nothing new
    changed = ("3", "renamed", T(20))
    connectors.changes_into(spark, memory([*ROWS, changed]), "ships", path, checkpoint)
    assert read() == Counter([*rows, changed])


def test_an_empty_system_streams_nothing(spark, tmp_path):
    connectors.changes_into(spark, memory([], "empty_harbour"), "ships", str(tmp_path / "rows"), str(tmp_path / "c"))
    assert spark.read.schema(KINDS).parquet(str(tmp_path / "rows")).count() == 0


def test_parquet_exports_by_row_groups(spark, tmp_path):
    table = pa.table({"id": [r[0] for r in ROWS], "name": [r[1] for r in ROWS], "modified_at": pa.array([r[2] for r in ROWS], pa.timestamp("us")), "other": [1] * 40})
    pq.write_table(table, tmp_path / "ships.parquet", row_group_size=7)
    system = connectors.ParquetConnector("exports", {"ships": (KINDS, str(tmp_path / "ships.parquet"))})
    rows = connectors.pulled(spark, system, "ships", "acme")
    assert rows.rdd.getNumPartitions() == 6 and ids(rows) == sorted(r[0] for r in ROWS)
    assert ids(rows.where(F.col("modified_at") > F.lit(T(6)))) == sorted(r[0] for r in ROWS if r[2] and r[2] > T(6))
    assert system.mark("ships") == T(9)
    assert ids(connectors.pulled(spark, system, "ships", "acme", "2024-01-08")) == sorted(r[0] for r in ROWS if r[2] is None or r[2] > T(8))

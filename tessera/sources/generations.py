"""Tables in a folder whose partitions change together, in one switch.

A load writes its rows into a folder of its own (``rows/load=.../part=...``). Then
one small file says which partitions the load replaces and which it adds to; with
it the load is there, all at once. Readers take the loads that those files name, so
that a load that fails before its file is written changes nothing, and readers that
began before go on with what they had. One job writes a table at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, part int, load string, replaces boolean"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where one machine does all."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.work.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.work.dir", found)
    return found.rstrip("/")


class Generations:
    """A table partitioned by ``part`` (int), of rows with ``schema``.

    The driver holds the log: a row for each partition that a load touched.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def version(self) -> int:
        """Number of the newest switch; 0 before the first."""
        return max((r["version"] for r in self._log()), default=0)

    def loads(self, version: int | None = None) -> dict[str, set[int]]:
        """Partitions that readers take from each load."""
        rows = [r for r in self._log() if version is None or r["version"] <= version]
        since: dict[int, int] = {}
        for r in rows:
            if r["replaces"]:
                since[r["part"]] = max(since.get(r["part"], 0), r["version"])
        found: dict[str, set[int]] = {}
        for r in rows:
            if r["load"] is not None and r["version"] >= since.get(r["part"], 0):
                found.setdefault(r["load"], set()).add(r["part"])
        return found

    def read(self, parts: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows and ``part``, of all partitions or of ``parts``: others are not opened."""
        wanted = None if parts is None else sorted(set(parts))
        loads = {load: held if wanted is None else held & set(wanted) for load, held in self.loads(version).items()}
        loads = {load: held for load, held in loads.items() if held}
        kinds = f"{self.schema}, load string, part int"
        if not loads:
            return self.spark.createDataFrame([], kinds).drop("load")
        rows = self.spark.read.schema(kinds).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/load={load}" for load in sorted(loads)])
        kept = F.lit(False)
        for held in {frozenset(h) for h in loads.values()}:
            kept |= F.col("load").isin([load for load, h in loads.items() if h == held]) & F.col("part").isin(sorted(held))
        return rows.where(kept).drop("load")

    def stage(self, rows: DataFrame, *order: str, then: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Write rows (with ``part``) where no reader looks yet; returns the load's name.

        Large partitions are written by several tasks, small ones together.
        ``then`` makes fewer rows of those that a task has sorted.
        """
        load = uuid.uuid4().hex
        rows = rows.hint("rebalance", "part").sortWithinPartitions("part", *order)
        if then is not None:
            rows = then(rows).sortWithinPartitions("part", *order)
        rows.write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/rows/load={load}")
        return load

    def staged(self, load: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.path}/rows/load={load}")

    def commit(self, loads: list[str], replaced: Iterable[int] = ()) -> int:
        """The switch: ``replaced`` partitions now hold only rows of these loads, others hold theirs too."""
        version, replaced, rows = self.version() + 1, set(replaced), []
        for load in loads:
            for (part,) in self.staged(load).select("part").distinct().collect():
                rows.append((version, part, load, part in replaced))
        rows += [(version, part, None, True) for part in replaced - {r[1] for r in rows}]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

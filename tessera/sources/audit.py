"""An append-only log whose past can be checked: a chain of digests over its batches.

Each batch has a digest of its rows that doesn't depend on their order or files,
and a link: the hash of the link before and of that digest. A row that was changed,
removed or added later, and a batch that was lost or put in, break the chain there.
Whoever keeps the last link elsewhere also notices a chain that was written anew.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN = "batch long, n long, digest string, link string"


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as JSON, columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def batch_digests(rows: DataFrame, columns: list[str], batch: str = "batch") -> DataFrame:
    """batch, n and digest: sums of the four quarters of the rows' hashes, hashed. One aggregate, no sort."""
    hashed = rows.select(batch, row_digest(columns).alias("h"))
    quarter = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = hashed.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *[F.sum(quarter(i)).alias(f"s{i}") for i in range(4)])
    text = F.concat_ws(",", "n", *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select(batch, "n", F.sha2(text, 256).alias("digest"))


def linked(before: str, digest: str) -> str:
    return hashlib.sha256(f"{before}{digest}".encode()).hexdigest()


def links(digests: list[tuple[int, str]], first: str = "") -> list[tuple[int, str]]:
    """The link of each batch, in order."""
    out, link = [], first
    for batch, digest in sorted(digests):
        link = linked(link, digest)
        out.append((batch, link))
    return out


class AuditLog:
    """Rows in ``rows/batch=...`` and their chain in ``chain``. The driver holds a row for each batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/rows")

    def chain(self) -> list:
        """batch, n, digest and link of all batches, in order."""
        try:
            found = self.spark.read.schema(CHAIN).parquet(f"{self.path}/chain").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(found, key=lambda r: r["batch"])

    def append(self, rows: DataFrame) -> str:
        """Add a batch; its link is the log's new end. An empty batch is one too."""
        held = self.chain()
        batch = held[-1]["batch"] + 1 if held else 0
        # a batch that was cut off before it got its link is written anew
        rows.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        n, digest = self._digests().get(batch, (0, ""))
        link = linked(held[-1]["link"] if held else "", digest)
        self.spark.createDataFrame([(batch, n, digest, link)], CHAIN).coalesce(1).write.mode("append").parquet(f"{self.path}/chain")
        return link

    def _digests(self) -> dict[int, tuple[int, str]]:
        return {r["batch"]: (r["n"], r["digest"]) for r in batch_digests(self.rows(), self.columns).collect()}

    def first_broken(self, end: str | None = None) -> int | None:
        """The first batch that isn't what was appended, or None. ``end`` is the last link as it was noted elsewhere."""
        held, found = self.chain(), self._digests()
        before = ""
        for expected, r in enumerate(held):
            n, digest = found.pop(r["batch"], (0, ""))
            if r["batch"] != expected or (n, digest) != (r["n"], r["digest"]) or r["link"] != linked(before, digest):
                return expected
            before = r["link"]
        if end is not None and before != end:
            return max(0, len(held) - 1)
        return min(found, default=None)

"""Cosine distance and exact nearest rows, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ranked(rows: DataFrame, query: list[float], key: str = "id", column: str = "embedding", ranges: int = 256) -> DataFrame:
    """All rows that have a distance, with it and their absolute rank.

    Ranks are counted within ranges of the distance, whose bounds come from its
    quantiles, and moved by the counts of the ranges before: no task sees all rows.
    """
    found = rows.where(F.col(column).isNotNull()).withColumn("distance", F.round(cosine_distance(F.col(column), vector(query)), 6)).where("distance is not null")
    bounds = sorted(set(found.approxQuantile("distance", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    at = F.size(F.filter(vector(bounds), lambda b: b < F.col("distance"))) if bounds else F.lit(0)
    found = found.withColumn("_range", at)
    counts = {r["_range"]: r["n"] for r in found.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(i, 0)
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("distance", key))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range") + 1)
    return found.withColumn("rank", offset + nth).drop("_range")


def nearest(rows: DataFrame, query: list[float], k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """The k nearest rows with distance and rank: a top-k in each partition first, then ranks over k rows."""
    with_distance = rows.where(F.col(column).isNotNull()).withColumn("distance", F.round(cosine_distance(F.col(column), vector(query)), 6))
    top = with_distance.where("distance is not null").orderBy("distance", key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))

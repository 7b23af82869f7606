"""Retrieval quality: hits, comparisons, bands and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import plain


def first_hits(ranked: DataFrame, hit: Column, k: int = 8) -> DataFrame:
    """For each question: the position of its first hit, and whether it is within k."""
    best = F.min(F.when(hit, F.col("rank")))
    return ranked.groupBy("question").agg(best.alias("position")).withColumn("hit", F.coalesce(F.col("position") <= k, F.lit(False)))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions recovered, lost and the same between two configurations."""
    both = before.select("question", F.col("hit").alias("a")).join(after.select("question", F.col("hit").alias("b")), "question", "full").na.fill(False, ["a", "b"])
    return both.groupBy(F.when(F.col("b") & ~F.col("a"), "recovered").when(F.col("a") & ~F.col("b"), "lost").otherwise("same").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def markers_found(text: Column, markers: Column) -> Column:
    """The expected markers that a text holds, accents and case aside."""
    return F.filter(markers, lambda m: F.contains(plain(text), plain(m)))


def band(ranked: DataFrame, wide: int = 50) -> DataFrame:
    """Distance of the wide rank less that of the first: how well distances tell rows apart."""
    return ranked.groupBy("question").agg(F.round(F.max(F.when(F.col("rank") == wide, F.col("distance"))) - F.max(F.when(F.col("rank") == 1, F.col("distance"))), 6).alias("band"))


def cited_numbers(text: Column) -> Column:
    """Numbers in double square brackets, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[(\d{1,6})\]\]"), F.lit(1)), lambda x: x.cast("int"))))


def run_summary(runs: DataFrame) -> DataFrame:
    """Median and mean seconds and success share of each case; lost runs are left out of the share."""
    ended = ~F.col("lost")
    return runs.groupBy("case").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("lost")).alias("lost"), F.round(F.median(F.when(ended, F.col("seconds"))), 4).alias("median_s"), F.round(F.avg(F.when(ended, F.col("seconds"))), 4).alias("mean_s"), F.count_if(ended & F.col("good")).alias("good"))

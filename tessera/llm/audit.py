"""What each filter of a chain removes in every order: products of mask histograms.

Each document is reduced to the mask of the filters it fails. For each part a row of
counts by mask is stacked for all documents and for each label, and the stack is
multiplied by fixed integer matrices, 2**k masks by k! * k steps (32 by 600 for five
filters): a column says which masks are kept after, removed at, fail again at, or
fail only at a step of an order. All orders come from one pass over the texts.

A copy fails if a smaller id has the same text. Equal texts are counted before they
meet, by text, mask, part and labels, so that a group of copies is a few rows.

Defined results: a null text is empty, a null part the empty string; a null id fails
nothing as a copy and makes no other fail; rows of one id and text are counted each
and none is the other's copy; several labels of an id count as 1 if any does; empty
tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def outcome_matrices(k: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray], np.ndarray]:
    """All orders of k filters; for each outcome a matrix, masks by (order, step); the filter of each column."""
    orders = list(permutations(range(k)))
    masks = np.arange(1 << k)[:, None]
    own = 1 << np.array(orders)
    before = (np.cumsum(own, 1) - own).ravel()[None, :]
    own = own.ravel()[None, :]
    earlier, fails = (masks & before) != 0, (masks & own) != 0
    found = {"kept": ~earlier & ~fails, "removed": ~earlier & fails, "redundant": earlier & fails, "unique_fails": masks == own}
    return orders, {name: found[name].astype(np.int64) for name in OUTCOMES}, np.array(orders).ravel()


def mask_of(failures: list[Column]) -> Column:
    """A bit for each failure, the first the lowest; null is no failure."""
    out = F.lit(0)
    for i, failure in enumerate(failures):
        out = out.bitwiseOR(F.when(F.coalesce(failure, F.lit(False)), 1 << i).otherwise(0))
    return out


def text_failures(text: Column) -> list[Column]:
    """Fewer than 200 words; under half of the words distinct; over 3 % capitals; any of ``#$%&*|``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    n = F.size(words)
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def mask_histograms(docs: DataFrame, failures: list[Column], labels: dict[str, Column], text: str = "text", part: Column | None = None, label_rows: DataFrame | None = None) -> DataFrame:
    """part, mask, n and a count for each label. The copy filter's bit follows those of ``failures``.

    ``labels`` are conditions on columns of ``label_rows`` (doc_id and others).
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit("")).alias("part"),
        mask_of(failures).alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
    )
    names = list(labels)
    if names and label_rows is not None:
        marked = label_rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in labels.items()])
        rows = rows.join(marked, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    else:
        rows = rows.select("*", *[F.lit(False).alias(name) for name in names])
    rows = rows.select("doc_id", "part", "mask", "digest", *[F.coalesce(F.col(name), F.lit(False)).alias(name) for name in names])
    keys = ["digest", "part", "mask", *names]
    by_id = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # groups of one text differ in part and labels only
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    stay = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = by_text.select(*keys, "n", stay.alias("stay"))
    copy = F.array(F.struct(F.col("mask").alias("m"), F.col("stay").alias("c")), F.struct(F.col("mask").bitwiseOR(1 << len(failures)).alias("m"), (F.col("n") - F.col("stay")).alias("c")))
    apart = both.select("part", *names, F.explode(copy).alias("x")).select("part", *names, F.col("x.m").alias("mask"), F.col("x.c").alias("c"))
    return apart.groupBy("part", "mask").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col(name), F.col("c")).otherwise(0)).alias(name) for name in names])


def interactions(histograms: DataFrame, filters: str, lost: dict[str, str]) -> DataFrame:
    """A row for each part, order of ``filters`` (a letter each) and step.

    ``lost`` names the column of removed documents of a label. One part's counts, a
    row for each mask at most, are one row of the product.
    """
    names = list(lost)
    k = len(filters)
    counts = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *names)).alias("rows"))
    outputs = [*OUTCOMES, *lost.values(), "shapley"]

    def run(batches):
        orders, matrix, own = outcome_matrices(k)
        letters = ["".join(filters[i] for i in order) for order in orders for _ in order]
        steps = list(range(1, k + 1)) * len(orders)
        sums = (own[:, None] == np.arange(k)).astype(np.int64)
        for batch in batches:
            parts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            stack = np.zeros((1 + len(names), len(parts), 1 << k), np.int64)  # mask rows, then those of each label
            for at, part in enumerate(rows):
                for r in part:
                    stack[:, at, r["mask"]] = [r["n"], *[r[name] for name in names]]
            out = {name: stack[0] @ matrix[name] for name in OUTCOMES}
            for at, name in enumerate(names, 1):
                out[lost[name]] = stack[at] @ matrix["removed"]
            out["shapley"] = (out["removed"] @ sums)[:, own]
            for at, part in enumerate(parts):
                columns = [pa.array([part] * len(steps), pa.string()), pa.array(letters), pa.array(steps, pa.int32()), *[pa.array(out[name][at]) for name in outputs]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *outputs])

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in outputs))


def audit_filters(docs: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Five filters of whole texts, A to E, in all 120 orders, by language."""
    text = F.coalesce(F.col("text"), F.lit(""))
    labels = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    found = mask_histograms(docs, text_failures(text), labels, label_rows=label_rows)
    return interactions(found, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of five filters on all ``documents`` and ``labels``."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT x.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words x LEFT JOIN marks m ON x.doc_id = m.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, own)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a JOIN letters b ON b.own <> a.own JOIN letters c ON c.own NOT IN (a.own, b.own)
  JOIN letters d ON d.own NOT IN (a.own, b.own, c.own) JOIN letters e ON e.own NOT IN (a.own, b.own, c.own, d.own)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, l.own, l.letter,
         (SELECT coalesce(sum(p.own), 0) FROM letters p WHERE strpos(left(filter_order, step - 1), p.letter) > 0) AS before
  FROM orders, range(1, 6) r(step), letters l WHERE l.letter = substr(filter_order, step, 1)),
parts AS (SELECT DISTINCT part FROM texts),
results AS (
  SELECT p.part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (before + own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
  FROM parts p JOIN counts c ON p.part = c.part, (SELECT filter_order, step, letter, own, CAST(before AS INTEGER) AS before FROM steps) s
  GROUP BY p.part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM results
"""

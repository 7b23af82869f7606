"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a share of all words in proportion to its weight, at most
``cap`` times its own size. A document of a source with rate r = target / size
is taken floor(r) times, and once more with probability r - floor(r). These
extra copies are drawn by the cube method: the vector of inclusion
probabilities moves through the null space of two constraints (number of
documents, number of words) until nearly all entries are 0 or 1.

Each step of the flight moves the longest open document against all shorter ones,
in proportion to their slack, so that long documents are settled first and the
entries that stay open are short.

A source's documents are dealt into blocks by a hash, so that a source with a
third of all rows is many tasks. Each block's flight leaves two open entries at
most; those of ``fan_in`` blocks meet in the next round. The last block of a
source lands: its last ``LANDING`` open entries are set, and three pairs at
most exchanged, so that the words taken come nearest to the target.

Defined results: null text has size 0; null sources are one source, ordered
last; a source of size 0 has target 0; an empty table gives an empty mix; rows
alike in id, source and text are one entry of the cube that stands for so many
copies, which are dealt evenly to the rows. Reruns agree: the order inside a block
and its random numbers depend on the rows alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, table, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP, BLOCK, FAN_IN = 3.0, 2000, 500
#: Sources that one task puts in order.
NUMBERED = 100_000
#: Open entries of a source that are set at once, by trying all choices.
LANDING = 12
_EPS = 1e-9


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator, least: int = 2) -> np.ndarray:
    """Cube flight: returns probabilities of which ``least`` at most are not 0 or 1; sum(pi) and sum(pi * x) stay."""
    out = pi.astype(float).copy()
    at = np.argsort(-x, kind="stable")
    at = at[(out[at] > _EPS) & (out[at] < 1 - _EPS)]
    p, size = out[at], x[at].astype(float)
    draws = iter(rng.random(2 * len(at) + 4).tolist())
    while len(at) > max(1, least - 1):
        u = np.zeros(len(at))
        slack = p[1:] * (1 - p[1:])
        # the longest against all others: these move by slack * (a + b * size), so that both totals stay
        apart = size[1:] - (slack * size[1:]).sum() / slack.sum()
        spread = (slack * apart * apart).sum()
        if size[0] == size[-1]:
            u[0], u[1:] = 1.0, -slack / slack.sum()
        elif size[1] != size[-1]:
            u[0], u[1:] = 1.0, -slack * (1 / slack.sum() + apart * (apart[0] + size[0] - size[1]) / spread)
        elif len(at) > 2:  # one is longer than all others, and these are alike
            u[1:3] = 1.0, -1.0
        else:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, -(1 - p) / u, np.inf)).min()
        p = p + (up if next(draws) * (up + down) < down else -down) * u
        settled = (p <= _EPS) | (p >= 1 - _EPS)
        out[at[settled]] = p[settled] > 0.5
        at, p, size = at[~settled], p[~settled], size[~settled]
    out[at] = p
    out[(out <= _EPS) | (out >= 1 - _EPS)] = np.round(out[(out <= _EPS) | (out >= 1 - _EPS)])
    return out


def land(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Set the open entries (``LANDING`` at most) to 0 or 1 so that sum(pi * x) changes least, then sum(pi)."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(choices @ x[open_] - (pi[open_] * x[open_]).sum())
        rows = np.abs(choices.sum(1) - pi[open_].sum())
        pi = pi.copy()
        pi[open_] = choices[np.lexsort((rows, np.round(words, 6)))[0]]
    return pi


def exchange(pi: np.ndarray, before: np.ndarray, x: np.ndarray, times: int = 3) -> np.ndarray:
    """``pi``, all 0 or 1, with a few entries exchanged (or one set, or one taken out) so that sum(pi * x) comes nearest to that of ``before``."""
    pi = pi.copy()
    free = (before > _EPS) & (before < 1 - _EPS)
    for _ in range(times):
        over = float(((pi - before) * x).sum())
        # place -1: none
        taken, left = (np.append(np.flatnonzero(free & (pi == v)), -1) for v in (1, 0))
        size = np.append(x, 0.0)
        left = left[np.argsort(size[left], kind="stable")]
        near = np.searchsorted(size[left], size[taken] - over)
        near = np.stack([np.maximum(near - 1, 0), np.minimum(near, len(left) - 1)])
        error = np.abs(over - size[taken] + size[left[near]])
        side, at = np.unravel_index(np.argmin(error), error.shape)
        if error[side, at] >= abs(over) - _EPS:
            break
        for i, v in ((taken[at], 0.0), (left[near[side, at]], 1.0)):
            if i >= 0:
                pi[i] = v
    return pi


def numbered(per: DataFrame, rows: int = NUMBERED) -> DataFrame:
    """``per`` (one row for each source) with ``number``: its place by source, nulls last.

    The sources are dealt by ranges of their names, numbered in each range, and
    moved by the number of those in the ranges before: a task holds ``rows`` or so.
    """
    n = max(1, -(-per.count() // rows))
    order = F.col("source").asc_nulls_last()
    dealt = written(per.repartitionByRange(n, order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before, base = 0, []
    for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each range
        base.append((r["range"], before))
        before += r["n"]
    base = per.sparkSession.createDataFrame(base, "range int, base long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return dealt.withColumn("nth", nth).join(base, "range").withColumn("number", F.col("base") + F.col("nth")).drop("range", "nth", "base")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n_entries and target of each source of ``sizes`` (source, size, m rows each).

    Targets share the sum of all sizes by weight; what exceeds ``cap`` times a
    source's size is shared again among the others, by weight, until none is
    above. Each round is one aggregate of the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_entries"))
    # weights repeat along the order of the sources, so that order has to be known
    ranked = numbered(written(per, "mix-sources"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    per = written(ranked.withColumn("weight", weight).drop("number"), "mix-weights")
    limit = F.col("source_size") * F.lit(float(cap))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        full = limit <= F.lit(level) * F.col("weight")
        open_weight, fixed = per.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit))).first()
        if not open_weight:
            break
        level, before = max(level, (total - (fixed or 0.0)) / open_weight), level
    return per.select("source", "source_size", "n_entries", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def sample_mix(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``sizes`` (doc_id, source, size, k1, k2, m rows) with source_size, target and copies (of all m rows) of each entry."""
    targets = source_targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("m")
    whole = F.floor(rate + _EPS)
    dealt = (
        sizes.withColumnRenamed("source", "own")
        .join(targets, F.col("own").eqNullSafe(F.col("source")))
        .withColumn("whole", whole.cast("long"))
        .withColumn("pi", F.greatest(rate - whole, F.lit(0.0)))
        .withColumn("blocks", F.ceil(F.col("n_entries") / F.lit(block)).cast("long"))
        .withColumn("block", F.expr("pmod(xxhash64(doc_id, size, k1), blocks)"))
        .drop("own")
    )
    schema = dealt.schema

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_h=[zlib.crc32(str(d).encode()) for d in rows["doc_id"]]).sort_values(["size", "_h", "doc_id", "k1", "k2"], ascending=[False, True, True, True, True], kind="stable").drop(columns="_h")
        first = rows.iloc[0]
        rng = np.random.default_rng(zlib.crc32(f"{first['source']}|{first['block']}|{first['blocks']}".encode()))
        pi, x = rows["pi"].to_numpy(float), rows["size"].to_numpy(float)
        if first["blocks"] == 1:
            pi = exchange(land(flight(pi, x, rng, LANDING), x), pi, x)
        else:
            pi = flight(pi, x, rng)
        return rows.assign(pi=pi)

    done, moving = [], dealt
    most = targets.agg(F.max(F.ceil(F.col("n_entries") / F.lit(block)))).first()[0] or 1
    while True:
        moved = written(moving.groupBy("source", "block", "blocks").applyInPandas(move, schema), "mix-round")
        if most <= 1:
            done.append(moved)
            break
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        # a source that has landed already has no open rows
        done.append(moved.where(~open_))
        moving = moved.where(open_).withColumn("block", F.floor(F.col("block") / fan_in).cast("long")).withColumn("blocks", F.ceil(F.col("blocks") / fan_in).cast("long"))
        most = -(-int(most) // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("whole") + F.round("pi").cast("long")).drop("whole", "pi", "block", "blocks", "n_entries")


def _words(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _keys() -> list:
    """k1 and k2: what tells rows apart that differ in id, source or text."""
    own = (F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("source").cast("string"), F.col("source").isNull(), F.col("text"))
    return [F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(1), *own).alias("k2")]


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (number of words), k1, k2 and m (number of rows) of rows alike in id, source and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"), *_keys())
    return rows.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count(F.lit(1)).alias("m"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with the columns of ``docs``.

    Rows alike in id, source and text are interchangeable: where they are to be
    taken k times, one of them stands for all. Empty input gives an empty mix.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    mixed = sample_mix(written(document_sizes(docs), "mix-sizes")).where("copies > 0")
    taken = written(mixed.select("k1", "k2", "m", F.col("copies").alias("taken_copies")), "mix-taken")
    one, two = _keys()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], one.alias(k1), two.alias(k2))

    def joined(rows: DataFrame, taken: DataFrame) -> DataFrame:
        out = rows.join(taken, (F.col(k1) == taken["k1"]) & (F.col(k2) == taken["k2"])) if (k1, k2) != ("k1", "k2") else rows.join(taken, ["k1", "k2"])
        return out.select(*[rows[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])

    several = taken.where("m > 1")
    out = joined(rows, taken.where("m = 1"))
    if several.isEmpty():
        return out
    alike = rows.join(several.select(F.col("k1").alias("_a"), F.col("k2").alias("_b")), (F.col(k1) == F.col("_a")) & (F.col(k2) == F.col("_b")), "left_semi").dropDuplicates([k1, k2])
    return out.unionByName(joined(alike, several))


#: Rows of one entry that one task writes.
_ROWS = 100_000


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return mixed_rows(table(spark, sf_dir, "documents"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row."""
    mixed = sample_mix(written(document_sizes(docs), "op5-sizes"))

    def spread(entries: DataFrame, first, last) -> DataFrame:
        rows = entries.withColumn("nth", F.explode(F.sequence(first, last)))
        copies = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("nth") < F.col("copies") % F.col("m"), 1).otherwise(0)
        return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))

    zero, end = F.lit(0).cast("long"), F.col("m") - 1
    out = spread(mixed.where(F.col("m") <= _ROWS), zero, end)
    many = mixed.where(F.col("m") > _ROWS)
    if many.isEmpty():
        return out
    many = many.withColumn("part", F.explode(F.sequence(zero, F.floor(end / _ROWS)))).repartition("doc_id", "k1", "part")
    return out.unionByName(spread(many, F.col("part") * _ROWS, F.least(end, (F.col("part") + 1) * _ROWS - 1)))

"""Benchmark decontamination by greedy string tiling.

Seeds: runs of ``MIN_MATCH`` words that a document shares with a benchmark item.
For each document and item with a shared seed, greedy tiling marks the longest
common run of unmarked words, again and again; runs are found by Karp-Rabin
hashes at search lengths that fall from long to ``MIN_MATCH``. A document is
contaminated if the tiles cover ``THRESHOLD`` of an item's words or more: the
passages may stand in any order.

The benchmark is a stated query set. It is held in blocks of ``BLOCK_BYTES`` at
most; each block is run against all documents in turn, so that what a task holds
doesn't grow with the benchmark.

Defined results: words are runs of letters and digits, in lower case; null and
empty texts, and items of fewer than ``MIN_MATCH`` words, match nothing (coverage
0, item null); of items with equal coverage the smallest id is named; repeated
rows get equal results; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, with_columns_from, worker_state, written

MIN_MATCH, THRESHOLD, BLOCK_BYTES = 4, 0.5, 32 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Karp-Rabin hashes of all windows of a sequence of word ids, for any length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
            self.sums = np.append(np.uint64(0), np.cumsum(mixed * power[:n]))
            self.inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))

    def at(self, where: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[where + length] - self.sums[where]) * self.inverse[where]


def tiles(doc: np.ndarray, item: np.ndarray, spots: np.ndarray, min_match: int = MIN_MATCH, hashes: Hashes | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``item`` by runs of ``doc``: (start in doc, start in item, length).

    ``spots`` are the positions in ``doc``, in order, where a run of ``min_match``
    words may begin. Of runs of equal length the first in the item goes first,
    and of its places in the document the first. The longest length that is left
    is found by bisection over Karp-Rabin hashes; all tiles of that length are
    placed before the search goes on below it, so that the cost doesn't grow with
    the number of pairs of places.
    """
    if not len(spots) or len(item) < min_match:
        return []
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    hash_doc, hash_item = hashes or Hashes(doc), Hashes(item)

    def common(length: int):
        """Free places of equal hashes: in the document and in the item, with hashes of either."""
        # tiles are longer than what is searched for: a run that meets one has an end in it
        i, j = spots[spots + length <= len(doc)], np.arange(len(item) - length + 1)
        i, j = i[~(in_doc[i] | in_doc[i + length - 1])], j[~(in_item[j] | in_item[j + length - 1])]
        hi, hj = hash_doc.at(i, length), hash_item.at(j, length)
        known = np.unique(hj)
        if not len(known):
            return i[:0], j[:0], hi[:0], hj[:0]
        hit = known[np.minimum(np.searchsorted(known, hi), len(known) - 1)] == hi
        return i[hit], j, hi[hit], hj

    jumps = np.flatnonzero(np.append(True, spots[1:] != spots[:-1] + 1))
    most = min(len(item), int(np.diff(np.append(jumps, len(spots))).max()) + min_match - 1)
    out: list[tuple[int, int, int]] = []
    while most >= min_match:
        low, high = min_match - 1, most  # some run has the length low, or low is too short to count
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < min_match:
            break
        i, j, hi, hj = common(low)
        places = defaultdict(list)
        for h, at in zip(hi.tolist(), i.tolist(), strict=True):
            places[h].append(at)
        for rest in places.values():
            rest.reverse()
        for h, to in zip(hj.tolist(), j.tolist(), strict=True):
            if in_item[to] or in_item[to + low - 1]:
                continue
            rest = places.get(h, ())
            while rest and (in_doc[rest[-1]] or in_doc[rest[-1] + low - 1]):
                rest.pop()
            if rest and (doc[rest[-1] : rest[-1] + low] == item[to : to + low]).all():
                at = rest.pop()
                in_doc[at : at + low] = in_item[to : to + low] = True
                out.append((at, to, low))
        most = low - 1
    return out


class Benchmark:
    """Items as word ids, and the items under each seed."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.min_match, self.vocabulary, self.items, self.names = min_match, {}, [], []
        under = defaultdict(set)
        for name, text in sorted(items):
            words = _WORD.findall(text.lower())
            if len(words) < min_match:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            for h in Hashes(ids).at(np.arange(len(ids) - min_match + 1), min_match).tolist():
                under[h].add(len(self.items))
            self.items.append(ids)
            self.names.append(name)
        self.under = {h: sorted(x) for h, x in under.items()}
        self.seeds = np.array(sorted(under), np.uint64)

    def match(self, text: str) -> list[tuple[int, float]]:
        """(item id, coverage) of each item that shares a seed with the text."""
        get, m = self.vocabulary.get, self.min_match
        words = np.array([get(w, 0) for w in _WORD.findall(text.lower())], np.int64)
        if len(words) < m or not len(self.seeds):
            return []
        unknown = np.append(0, np.cumsum(words == 0))
        spots = np.flatnonzero(unknown[m:] == unknown[:-m])
        if not len(spots):
            return []
        hashes = Hashes(words)
        h = hashes.at(spots, m)
        place = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hit = self.seeds[place] == h
        spots, h = spots[hit], h[hit]
        near = defaultdict(list)
        for at, x in zip(spots.tolist(), h.tolist(), strict=True):
            for k in self.under[x]:
                near[k].append(at)
        out = []
        for k, at in near.items():
            n = len(self.items[k])
            covered = sum(t[2] for t in tiles(words, self.items[k], np.array(at), m, hashes))
            out.append((self.names[k], covered / n))
        return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark (item_id, text) in lists of bounded size."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def _scores(docs: DataFrame, block: list, threshold: float) -> tuple[DataFrame, list[str]]:
    """``docs`` with best coverage, its item and the number of items at or above ``threshold``, for one block of the benchmark."""

    mark = hashlib.sha256(repr(block).encode()).hexdigest()

    def make():
        held = worker_state("benchmark", dict)  # one block's index, kept for the worker's next tasks
        if held.get("mark") != mark:
            held.clear()
            held.update(mark=mark, bench=Benchmark(block))
        bench = held["bench"]

        def run(texts):
            best, name, n = np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                for item, cover in bench.match(text):
                    n[i] += cover >= threshold
                    if cover > best[i] or cover == best[i] > 0 and item < name[i]:
                        best[i], name[i] = cover, item
            return [pa.array(best), pa.array(name, pa.int64()), pa.array(n)]

        return run

    return with_columns_from(docs, "text", make, [("coverage", "double"), ("item_id", "long"), ("n_items", "long")])


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """``docs`` with best coverage, its item and the number of items at or above ``threshold``; and these columns' names.

    A benchmark of one block takes one pass. Of a larger one each block reads the
    texts once and writes scores of rows alone, which are joined to the rows at
    the end.
    """
    blocks = item_blocks(items)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _scores(docs, block, threshold)
    (uid,) = fresh(docs, "uid")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "decontamination-rows")
    texts, scores = rows.select(F.col(uid).alias("uid"), "text"), None
    for part in chain([block, more], blocks):
        found, (c, i, n) = _scores(texts, part, threshold)
        found = written(found.where(F.col(c) > 0).select("uid", F.col(c).alias("cover"), F.col(i).alias("item"), F.col(n).alias("n")), "decontamination-scores")
        scores = found if scores is None else scores.unionByName(found)
    best = F.max(F.struct("cover", (-F.col("item")).alias("item")))
    scores = scores.groupBy("uid").agg(best.alias("best"), F.sum("n").alias("n")).select(F.col("uid").alias("scored"), F.col("best.cover").alias("cover"), (-F.col("best.item")).alias("item"), "n")
    names = fresh(docs, "coverage", "item_id", "n_items")
    values = (F.coalesce("cover", F.lit(0.0)), F.col("item"), F.coalesce("n", F.lit(0)))
    # the names of scores may clash with columns of the rows: each side is told by its frame
    left = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(uid).alias("uid"))
    out = left.join(scores, left["uid"] == scores["scored"], "left")
    return out.select("row", *[v.alias(f"value{k}") for k, v in enumerate(values)]).select("row.*", *[F.col(f"value{k}").alias(x) for k, x in enumerate(names)]), names


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` without those that hold ``THRESHOLD`` of a benchmark item."""
    out, (_, _, n) = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.col(n) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: doc_id, contaminated, coverage, item_id, n_items."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, (c, i, n) = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col(n) > 0).alias("contaminated"), F.col(c).alias("coverage"), F.col(i).alias("item_id"), F.col(n).alias("n_items"))

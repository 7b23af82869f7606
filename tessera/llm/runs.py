"""Runs of words: stretches that repeat one period, found through Lyndon arrays.

Ellert and Fischer's way over an ordered alphabet: the suffix that starts at each
word is compared with those to its left that no smaller one hides; the next smaller
suffix ends the longest Lyndon word there, and every run has such a word as its
root in the order of the words or in the reverse order. How far two suffixes agree
is kept with each comparison and used again, either from the pair a match further
left or from the suffix just passed; only words beyond the furthest match are
looked at, each once, so that the Lyndon arrays take linear time without suffix
arrays, suffix trees or hashes.

Defined results: a null text has no words; a null id is never rewritten
(``periodic_tail``) and stays null; empty tables give no rows; repeated rows each
give theirs; extra columns don't matter. A text is one task's work, in time and
memory linear in its words.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes

#: Shortest run in words, and how often a run holds its period at least.
MIN_LENGTH, MIN_PERIODS = 6, 4


def lyndon_edges(s: list[int], periods: int = 2, work: list[int] | None = None) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Next smaller suffixes, how far they agree, and the pairs that may be roots of runs.

    ``nss[i]`` is the start of the next suffix that is smaller than suffix i, or
    the length; s[i:nss[i]] is the longest Lyndon word at i. ``lce[i]`` is how many
    words suffix i shares with it. The third list has (i, nss[i], lce[i]) where the
    two agree for more than ``periods - 2`` periods, as the first root of a run of
    so many periods does. ``work`` gets the number of words looked at beyond the
    first of a comparison.
    """
    n = len(s)
    pss, plce, nss, nlce, roots = [-1] * n, [0] * n, [n] * n, [0] * n, []
    reach = shift = looked = 0  # s[reach - x] for x up to the match agrees with the words shift before
    more = periods - 2
    for r in range(1, n):
        c, l, up, m = s[r], r - 1, -1, 0
        while l >= 0:
            d = s[l]
            if d != c:
                if d < c:
                    break
                nss[l], up, m = r, l, 0
                l = pss[l]
                continue
            k, known = 1, False
            if m:  # suffix `up` was passed: how it agrees with both says how they agree
                a = plce[up]
                k, known = (a if a < m else m), a != m
            if not known:
                if r + k < reach:  # the same pair was compared `shift` words before
                    i, j = l - shift, r - shift
                    a = nlce[i] if nss[i] == j else plce[j]
                    k, known = (a, True) if a < reach - r else (reach - r, False)
                if not known:
                    while r + k < n and s[l + k] == s[r + k]:
                        k += 1
                        looked += 1
                    if r + k >= reach:
                        reach, shift = r + k, r - l
            if r + k < n and s[l + k] < s[r + k]:
                plce[r] = k
                break
            nss[l], nlce[l], up, m = r, k, l, k
            if k > more * (r - l):
                roots.append((l, r, k))
            l = pss[l]
        pss[r] = l
    if work is not None:
        work.append(looked)
    return nss, nlce, roots


def find_runs(s: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ``s``, by start, then period.

    A run has ``min_length`` words and ``min_periods`` of its smallest period at
    least (two periods or more). Of the roots that end alike the first is taken;
    less than a period lies before it, so that looking for the run's start costs
    less than the run is long.
    """
    first: dict[tuple[int, int], int] = {}
    for order in (s, [-c for c in s]):
        for l, r, k in lyndon_edges(order, min_periods)[2]:
            at = (r + k, r - l)
            if first.get(at, l) >= l:
                first[at] = l
    out = []
    for (end, p), l in first.items():
        while l and s[l - 1] == s[l - 1 + p]:
            l -= 1
        if end - l >= max(min_length, min_periods * p):
            out.append((l, end - l, p))
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, p in runs:
        gone[start + p : start + length] = b"\x01" * (length - p)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def runs_in_words(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``find_runs`` of words, ordered by their first place."""
    codes: dict = {}
    return find_runs([codes.setdefault(w, len(codes)) for w in words], min_length, min_periods)


def periodic_tail(doc_id: int | None, words: list) -> list:
    """Words of a tenth of all ids, chosen by the id's checksum, whose tail repeats a period; others as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * times + words[a : a + rest]


def collapse_runs(df: DataFrame, column: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``df``'s rows as ``row``, with ``runs`` (start, length, period) of the words in ``column`` and the text ``collapsed``: words that stay, joined by a space.

    A null text has no runs and an empty collapsed text.
    """

    def run(batches):
        for batch in small_batches(batches, 1):
            found, kept = [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                runs = runs_in_words(words, min_length, min_periods)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(kept, pa.string())], ["row", "runs", "collapsed"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b"")).alias("words"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def described(words: list, runs: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the one of the most periods with its thousandths of periods, and the digests of all runs and of the words that stay."""
    best = (None,) * 4
    if runs:
        start, length, period = runs[0]
        for s, n, p in runs[1:]:  # whole numbers, no rounding; earlier runs win ties
            if n * period > length * p:
                start, length, period = s, n, p
        best = (start, length, period, 1000 * length // period)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return (len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def run_digests(docs: DataFrame) -> DataFrame:
    """A row for each document: its runs after ``periodic_tail``, and what stays without them."""

    def run(batches):
        for batch in small_batches(batches, 1):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = periodic_tail(doc_id, text.split())
                out.append((doc_id, *described(words, runs_in_words(words))))
            columns = list(zip(*out, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], [f for f, _ in FIELDS])

    schema = ", ".join(f"{f} {'long' if k == pa.int64() else 'string'}" for f, k in FIELDS)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(run, schema)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text of ``documents``, one row each."""
    return run_digests(table(spark, sf_dir, "documents"))

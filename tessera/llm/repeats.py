"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if it is covered by a ``LENGTH``-byte string that starts anywhere
else too. The work is dealt by content, so that equal strings meet wherever they
stand:

1. Anchors. Each window of ``LENGTH`` bytes picks one of the ``SEED``-byte strings
   in it, the one with the smallest hash, leftmost first. The choice depends on
   the window's bytes alone, so equal windows pick equal seeds at equal places.
   Windows in a row with the same anchor form a span. Spans whose seed occurs
   once hold no repeated window and are left behind; equal spans are counted and
   go on as one.
2. Index family. Spans are dealt by seed. Each batch of spans that reaches a task
   gets suffix arrays: of the text right of the anchors, and of the reversed text
   left of them. It is merge-scanned against itself and each level: a window d
   bytes left of its anchor occurs twice if two neighbours agree on LENGTH - d
   bytes to the right and d to the left. Levels of equal rank merge, so that
   there are logarithmically many. The levels are rows of a table, and a later
   load of documents meets them (``add_load``, ``RepeatIndex``).
3. Hot seeds, with more than ``HOT`` different spans, are cut into spans of fewer
   windows, whose keys are longer strings, and dealt again; in the last round a
   span is one window, and equal windows are just counted.

Passages of ``PASSAGE`` words and more that stand in another row too can be
shorter than ``LENGTH`` bytes or differ in white space: they are not removed, but
``passages`` counts a row's words in them. Anchors are chosen among words in the
same way; spans with a seed that other rows hold are equal or are compared
window by window, by 128-bit hashes, where their seed is dealt to; those of hot
seeds by a row for each window.

Rows are told by numbers of their own, equal spans by two hashes of 64 bits each
(of the seed and of the whole span); all other matches are found by comparing bytes.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing;
repeated rows count as occurrences of each other; a null doc_id is a document
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes, written

LENGTH, SEED = 400, 128
HOT, SHARD_SPANS, BATCH_SPANS = 2000, 16_000, 2000
#: Windows of a span in each round of cutting hot seeds.
CUTS = (16, 1)
#: Words of the shortest passage that counts, and of its seeds.
PASSAGE, PASSAGE_SEED = 51, 12
_PIECE, _INDEX_BITS = 4 << 20, 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans_of(texts: list[bytes], length: int = LENGTH, seed: int = SEED):
    """Spans of texts laid end to end: text, start, windows, bytes left of the anchor, hash of the seed, hash of the span."""
    return _spans(_TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64), length, seed)


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What gives the hash of values i to j-1 as (sums[j] - sums[i]) * inverse[i]."""
    n = len(values)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
        inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
        return np.append(np.uint64(0), np.cumsum(values * power[:n])), inverse


def _spans(values: np.ndarray, sizes: np.ndarray, length: int, seed: int):
    """``spans_of`` for texts of ``sizes`` symbols with these values."""
    window = length - seed + 1
    n = len(values)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    sums, inverse = _sums(values)
    with np.errstate(over="ignore"):
        seeds = _mix((sums[seed:] - sums[:-seed]) * inverse[: n - seed + 1])
    # smallest hash, then leftmost, in each window of seeds: by doubling
    least = (seeds & ~np.uint64((1 << _INDEX_BITS) - 1)) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    anchor = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    start = first[owner] + nth
    if not len(start):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    at = anchor[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
    with np.errstate(over="ignore"):
        content = (sums[hi + length] - sums[lo]) * inverse[lo]
        content = _mix(content * np.uint64(31) + ((at[new] - lo) * 1024 + (hi - lo)).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return owner[new], lo - first[owner[new]], hi - lo + 1, at[new] - lo, seeds[at[new]], content


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words."""
    edge = np.diff(((data != 32) & ((data < 9) | (data > 13))).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def passage_spans(texts: list[bytes], words: int = PASSAGE, seed: int = PASSAGE_SEED):
    """Spans of words: text, first word, windows, first byte, bytes, hash of the seed, hash of the span."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = _words(data)
    sums, inverse = _sums(_TABLE[data])
    with np.errstate(over="ignore"):
        values = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _BASE)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, begin)
    owner, lo, n, _, key, span = _spans(values, np.diff(first), words, seed)
    at = first[owner] + lo
    return owner, lo, n, starts[at] - begin[owner], ends[at + n + words - 2] - starts[at], key, span


def _pieces(text: bytes, words: int):
    """(first byte, first word, bytes) of pieces of a text that share words - 1 words; most texts are one piece."""
    at = nth = 0
    size = _PIECE
    while len(text) - at > size:
        starts, ends = _words(np.frombuffer(text, np.uint8, size, at))
        if len(starts) <= words:
            size *= 2
            continue
        # the last word may be cut: it belongs to the next piece
        yield at, nth, text[at : at + int(ends[-2])]
        back = len(starts) - words
        at, nth, size = at + int(starts[back]), nth + back, _PIECE
    yield at, nth, text[at:]


ROWS = "row long, key long, span long, lo int, n int, left int"


def packed_texts(docs: DataFrame, base: int = 0) -> DataFrame:
    """row (a number from ``base`` on), doc_id and z: whole texts, packed for their ways through shuffles."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack, row = zstandard.ZstdCompressor(level=1).compress, base + (TaskContext.get().partitionId() << 33)
        for batch in small_batches(batches, 1):
            z = pa.array([pack(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(z))), batch.column(0), z], ["row", "doc_id", "z"])
            row += len(z)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, "row long, doc_id long, z binary")


def anchored(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """The spans of all packed texts."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        pieces, rows, base, held = [], [], [], 0

        def out():
            owner, lo, n, left, key, span = spans_of(pieces, length, seed)
            cols = [np.array(rows, np.int64)[owner], key.view(np.int64), span.view(np.int64), (lo + np.array(base, np.int64)[owner]).astype(np.int32), n.astype(np.int32), left.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "key", "span", "lo", "n", "left"])

        for batch in batches:
            for row, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = unpack(z.as_py())
                for at in range(0, len(text) - length + 1, _PIECE):  # pieces of very long texts share length - 1 bytes
                    piece = text[at : at + _PIECE + length - 1]
                    pieces.append(piece)
                    rows.append(row)
                    base.append(at)
                    held += len(piece)
                    if held > 1 << 19:
                        yield out()
                        pieces, rows, base, held = [], [], [], 0
        if pieces:
            yield out()

    return texts.select("row", "z").mapInArrow(run, ROWS)


def passage_anchored(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """The spans of words of all packed texts."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        pieces, rows, base, nth, held = [], [], [], [], 0

        def out():
            owner, lo, n, at, size, key, span = passage_spans(pieces, words, seed)
            cols = [np.array(rows, np.int64)[owner], key.view(np.int64), span.view(np.int64), (lo + np.array(nth, np.int64)[owner]).astype(np.int32), n.astype(np.int32), (at + np.array(base, np.int64)[owner]).astype(np.int32), size.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "key", "span", "lo", "n", "at", "size"])

        for batch in batches:
            for row, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, word, piece in _pieces(unpack(z.as_py()), words):
                    pieces.append(piece)
                    rows.append(row)
                    base.append(at)
                    nth.append(word)
                    held += len(piece)
                    if held > 1 << 19:
                        yield out()
                        pieces, rows, base, nth, held = [], [], [], [], 0
        if pieces:
            yield out()

    return texts.select("row", "z").mapInArrow(run, "row long, key long, span long, lo int, n int, at int, size int")


def passage_windows(spans: DataFrame, words: int) -> DataFrame:
    """Each window of spans of words, told by a hash of its words."""

    def run(batches):
        for batch in few_rows(batches):
            cols = [[], [], []]
            for i, (n, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                w = data.split()
                cols[0] += [i] * n
                cols[1] += range(n)
                cols[2] += [xxhash.xxh3_128_digest(b" ".join(w[k : k + words])) for k in range(n)]
            of = pa.array(cols[0], pa.int64())
            arrays = [*(batch.column(j).take(of) for j in (0, 1)), pa.array(cols[1], pa.int32()), *(batch.column(j).take(of) for j in (3, 4)), pa.array(cols[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "span", "offset", "first", "last", "words"])

    return spans.select("key", "span", "n", "first", "last", "bytes").mapInArrow(run, "key long, span long, offset int, first long, last long, words binary")


def passage_offsets(spans: DataFrame, words: int) -> DataFrame:
    """key, span and the windows that another row holds too, of all spans of one row with each seed; a seed's spans are held in one task."""

    def run(batches):
        def compared(held):
            windows = []
            for _, n, _, _, data in held:
                w = data.split()
                windows.append([xxhash.xxh3_128_digest(b" ".join(w[k : k + words])) for k in range(n)])
            rows, several = {}, {}
            for (_, _, first, last, _), digests in zip(held, windows, strict=True):
                for d in digests:
                    several[d] = several.get(d, False) or first != last or rows.setdefault(d, first) != first
            for (span, _, first, last, _), digests in zip(held, windows, strict=True):
                if first == last and (found := [k for k, d in enumerate(digests) if several[d]]):
                    yield span, found

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["key", "span", "offsets"])

        key, held, done = None, [], []
        for batch in few_rows(batches):
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    done += [(key, *x) for x in compared(held)]
                    key, held = k, []
                held.append(rest)
            if len(done) > 4096:
                yield out(done)
                done = []
        yield out(done + [(key, *x) for x in compared(held)])

    dealt = spans.select("key", "span", "n", "first", "last", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, span long, offsets array<int>")


class Level:
    """Spans with their two suffix arrays: right of the anchors, and reversed left of them."""

    def __init__(self, right: list[bytes], left: list[bytes], n: np.ndarray, c: np.ndarray, ids: np.ndarray, by_right=None, by_left=None):
        self.right, self.left, self.n, self.c, self.ids = right, left, n, c, ids
        # merging two sorted runs: Python's sort takes linear time for it
        self.by_right = sorted(range(len(right)) if by_right is None else by_right, key=right.__getitem__)
        self.by_left = sorted(range(len(left)) if by_left is None else by_left, key=left.__getitem__)

    def merged(self, other: Level) -> Level:
        k = len(self.right)
        shift = lambda order: [i + k for i in order]
        join = lambda a, b: np.concatenate([a, b])
        return Level(self.right + other.right, self.left + other.left, join(self.n, other.n), join(self.c, other.c), join(self.ids, other.ids), self.by_right + shift(other.by_right), self.by_left + shift(other.by_left))


def _lcp(texts: list[bytes], order: list[int]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    size = np.array([len(texts[i]) for i in order])
    width = max(1, int(size.max(initial=1)))
    for at in range(1, len(order), 4096):
        part = order[at - 1 : at + 4096]
        grid = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        s = size[at - 1 : at + 4096]
        out[at : at + 4096] = np.minimum(first, np.minimum(s[1:], s[:-1]))
    return out


def scan(level: Level, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(spans, their windows' offsets from the span's start) that occur twice or more among the level's spans."""
    count = len(level.right)
    by_right, by_left = np.array(level.by_right, np.int64), np.array(level.by_left, np.int64)
    lcp_right, lcp_left = _lcp(level.right, level.by_right), _lcp(level.left, level.by_left)
    left = np.array([len(x) for x in level.left])
    out = []
    right_class, left_class = np.empty(count, np.int64), np.empty(count, np.int64)
    for d in range(int((left - level.n).min()) + 1, int(left.max()) + 1):
        active = np.flatnonzero((d <= left) & (d > left - level.n))
        if len(active) < 2 and (not len(active) or level.c[active[0]] < 2):
            continue
        right_class[by_right] = np.cumsum(lcp_right < length - d)
        left_class[by_left] = np.cumsum(lcp_left < d) if d else 0
        both = right_class[active] * (count + 1) + left_class[active]
        _, index = np.unique(both, return_inverse=True)
        again = np.bincount(index, level.c[active])[index] >= 2
        if again.any():
            hit = active[again]
            out.append((level.ids[hit], left[hit] - d))
    return out


class IndexFamily:
    """Levels of suffix arrays; each batch is scanned against all of them, and levels of equal rank merge."""

    def __init__(self, length: int):
        self.length, self.levels, self.found = length, [], []

    def add(self, batch: Level) -> None:
        self.found += scan(batch, self.length)
        for _, level in self.levels:
            self.found += scan(batch.merged(level), self.length)
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            batch = self.levels.pop()[1].merged(batch)
            rank += 1
        self.levels.append((rank, batch))


SPANS = "key long, span long, n int, left int, c long, bytes binary"
#: A span in the table of levels: its level's rank and shard, its places in the two suffix arrays, and a bit for each window that occurs again.
LEVELS = f"{SPANS}, rank int, shard int, by_right int, by_left int, flags binary"


def scanned(spans: DataFrame, total: int, length: int, levels: DataFrame | None = None) -> DataFrame:
    """The table of ``levels`` after ``spans``, a new batch of ``total`` spans that share seeds, has been scanned against it and added."""

    def restored(rows: list) -> Level:
        places = lambda i: sorted(range(len(rows)), key=lambda j: rows[j][i])
        return Level([r[5][r[3] :] for r in rows], [r[5][: r[3]][::-1] for r in rows], np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), np.array([r[-1] for r in rows]), places(8), places(9))

    def run(batches):
        from itertools import groupby

        from pyspark import TaskContext

        family, kept, old = IndexFamily(length), [], []

        def flush(held):
            family.add(Level([b[l:] for _, _, _, l, _, b in held], [b[:l][::-1] for _, _, _, l, _, b in held], np.array([r[2] for r in held]), np.array([r[4] for r in held]), np.arange(len(kept), len(kept) + len(held))))
            kept.extend((*r, None) for r in held)

        held, seen, opened = [], set(), False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[6] is not None:  # rows of old levels come first, those of one level together
                    old.append((*row[:10], len(kept)))
                    kept.append((*row[:6], row[10]))
                    continue
                if not opened:
                    opened = True
                    for rank, part in groupby(old, key=lambda r: r[6:8]):
                        family.levels.append((rank[0], restored(list(part))))
                if row[:2] not in seen:
                    seen.add(row[:2])
                    held.append(row[:6])
                if len(held) >= BATCH_SPANS:
                    flush(held)
                    held = []
        if held:
            flush(held)
        if not kept:
            return
        if not opened:
            family.levels = [(rank[0], restored(list(part))) for rank, part in groupby(old, key=lambda r: r[6:8])]
        sizes = np.array([r[2] for r in kept])
        start = np.cumsum(np.append(0, sizes))
        flags = np.zeros(start[-1], bool)
        for i, r in enumerate(kept):
            if r[6] is not None:
                flags[start[i] : start[i + 1]] = np.unpackbits(np.frombuffer(r[6], np.uint8), count=r[2])
        for ids, offset in family.found:
            flags[start[ids] + offset] = True
        shard = TaskContext.get().partitionId()
        for rank, level in family.levels:
            count = len(level.ids)
            right, left = np.empty(count, np.int32), np.empty(count, np.int32)
            right[level.by_right] = left[level.by_left] = np.arange(count, dtype=np.int32)
            for at in range(0, count, 8192):
                ids = level.ids[at : at + 8192].tolist()
                cols = list(zip(*(kept[i][:6] for i in ids), strict=True))
                bits = [np.packbits(flags[start[i] : start[i + 1]]).tobytes() if flags[start[i] : start[i + 1]].any() else None for i in ids]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                fixed = [pa.array(np.full(len(ids), x, np.int32)) for x in (rank, shard)]
                arrays = [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *fixed, pa.array(right[at : at + 8192]), pa.array(left[at : at + 8192]), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in LEVELS.split(", ")])

    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LEVELS.split(", ")[6:]]
    every = spans.select("key", "span", "n", "left", "c", "bytes", *none)
    if levels is not None:
        every = every.unionByName(levels)
    dealt = every.repartition(max(1, -(-total // SHARD_SPANS)), "key")
    if levels is not None:
        dealt = dealt.sortWithinPartitions(F.col("rank").desc_nulls_last(), "shard")
    return dealt.mapInArrow(run, LEVELS)


def few_rows(batches, rows: int = 256):
    """Slices of Arrow batches of ``rows`` rows: lists of spans and their bytes are Python objects in a task."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def cut(spans: DataFrame, windows: int, length: int) -> DataFrame:
    """Spans of at most ``windows`` windows, under the hash of what these have in common; with the span they are from."""

    def run(batches):
        for batch in few_rows(batches):
            out = []
            for key, span, n, left, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for d0 in range((left - n + 1) // windows * windows, left + 1, windows):
                    low, high = max(d0, left - n + 1), min(d0 + windows - 1, left)
                    # all windows of this cut hold the bytes between the last start and the first end
                    own = xxhash.xxh3_64_intdigest(data[left - d0 : left - d0 - windows + 1 + length], d0)
                    part = data[left - high : left - low + length]
                    out.append((key, span, left - high, own, xxhash.xxh64_intdigest(part, high), high - low + 1, high, c, part))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), signed(cols[3]), signed(cols[4]), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.int64()), pa.array(cols[8], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["from_key", "from_span", "offset", "key", "span", "n", "left", "c", "bytes"])

    return spans.select("key", "span", "n", "left", "c", "bytes").mapInArrow(run, "from_key long, from_span long, offset int, " + SPANS)


def _joined(part: list[tuple[int, int, bytes | None]], n: int) -> bytes | None:
    """Flags of a span from those of its cuts: (offset, windows, flags; all set if None)."""
    flags = np.zeros(n, bool)
    for offset, windows, bits in part:
        flags[offset : offset + windows] |= True if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=windows).astype(bool)
    return np.packbits(flags).tobytes()


def newest(levels: DataFrame) -> DataFrame:
    """Rows of levels as the last load that met their seed left them."""
    columns = [c.split()[0] for c in LEVELS.split(", ")]
    return levels.groupBy("key", "span").agg(F.max_by(F.struct(*columns), "load").alias("r")).select("r.*")


def resolved(spans: DataFrame, length: int, hot: int, cuts: tuple[int, ...] = CUTS, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """key, span and flags of distinct spans with their bytes and counts, null flags where all windows occur again; and the new table of levels.

    With ``levels`` the spans are those that these don't hold yet.
    """
    # written first: a join of two plain tables can split a hot seed, one with an aggregate below it can't
    if "spans" not in spans.columns:
        seeds = written(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")), "repeat-seeds")
        spans = spans.join(seeds, "key")
    out = spans.where("c >= 2").select("key", "span", F.lit(None).cast("binary").alias("flags"))
    if not cuts:  # one window each: equal windows are one span
        return out, None
    several = spans.where((F.col("spans") > 1) & (F.col("spans") <= hot)).select("key", "span", "n", "left", "c", "bytes")
    if levels is not None:  # spans meet under one seed only: levels are read where the batch has that seed
        met = written(several.select("key").distinct(), "repeat-met-keys")
        levels = written(newest(levels.join(met, "key", "left_semi")), "repeat-met-levels")
    many = spans.where(F.col("spans") > hot).select("key", "span", "n", "left", "c", "bytes")
    total, more = spans.agg(F.count_if((F.col("spans") > 1) & (F.col("spans") <= hot)), F.count_if(F.col("spans") > hot)).first()
    total += levels.count() if levels is not None else 0
    after = written(scanned(several, total, length, levels), "repeat-levels")
    out = out.unionByName(after.where("flags is not null").select("key", "span", "flags"))
    if more:
        parts = written(cut(many, cuts[0], length), "repeat-cuts")
        own = parts.groupBy("key", "span").agg(F.first("n").alias("n"), F.first("left").alias("left"), F.sum("c").alias("c"), F.first("bytes").alias("bytes"))
        found, _ = resolved(written(own, "repeat-cut-spans"), length, hot, cuts[1:])

        def join(batches):
            for batch in few_rows(batches):
                flags = [_joined([(p["offset"], p["n"], p["flags"]) for p in part], max(p["offset"] + p["n"] for p in part)) for part in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.binary())], ["key", "span", "flags"])

        back = parts.select("key", "span", "from_key", "from_span", "offset", "n").join(found, ["key", "span"])
        back = back.groupBy(F.col("from_key").alias("key"), F.col("from_span").alias("span")).agg(F.collect_set(F.struct("offset", "n", "flags")).alias("parts"))
        out = out.unionByName(back.mapInArrow(join, "key long, span long, flags binary"))
    return out, after


@dataclass
class RepeatIndex:
    """What a later load meets: packed texts, their spans, and the levels of suffix arrays, as tables."""

    texts: DataFrame
    anchors: DataFrame
    levels: DataFrame
    #: Of each table what the last load added.
    added: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str, all_loads: bool = True) -> None:
        """Write the tables under ``path``, for ``RepeatIndex.load`` in a later job; or add the last load's rows to those that are there."""
        for name in ("texts", "anchors", "levels"):
            rows = getattr(self, name) if all_loads else self.added[name]
            rows.write.mode("errorifexists" if all_loads else "append").option("compression", "zstd").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RepeatIndex:
        return RepeatIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("texts", "anchors", "levels")))


def add_load(docs: DataFrame, index: RepeatIndex | None = None, length: int = LENGTH, seed: int = SEED, hot: int = HOT, keep_text: bool = False, passages: int | None = None) -> tuple[DataFrame, RepeatIndex]:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, with ``keep_text`` also the bytes that stay; and the index with this load.

    Strings are judged over this load and all those in ``index``. Earlier loads'
    results stay as they were given. With ``passages`` also n_passage_words: how
    many of the row's words lie in a run of so many words that another row holds
    too, whatever white space is between them; all texts are read for it.
    """
    base = 0 if index is None else 1 + (index.texts.agg(F.max("row")).first()[0] or 0)
    texts = written(packed_texts(docs, base), "repeat-texts")
    anchors = written(anchored(texts, length, seed), "repeat-anchors")
    every_text, rows = texts, anchors
    if index is not None:
        every_text = index.texts.unionByName(texts)
        met = written(anchors.select("key").distinct(), "repeat-met")
        rows = anchors.unionByName(index.anchors.join(met, "key", "left_semi"))
    # written first: a join of two plain tables can split a hot seed, one with an aggregate below it can't
    again = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "repeat-keys")
    rows = written(rows.join(again, "key", "left_semi"), "repeat-rows")
    spans = written(rows.groupBy("key", "span").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "lo", "n", "left")).alias("at")), "repeat-distinct")
    seeds = written(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")), "repeat-seeds")
    spans = written(spans.join(seeds, "key").select("key", "span", "c", "spans", "at.*"), "repeat-spans")

    if passages:
        every = written(passage_anchored(every_text, passages, min(PASSAGE_SEED, passages)), "repeat-passages")
        several = F.min("row").alias("first"), F.max("row").alias("last")
        met = written(every.groupBy("key").agg(*several).where("first < last").select("key"), "repeat-passage-keys")
        runs = written(every.join(met, "key", "left_semi"), "repeat-passage-rows")
        alike = written(runs.groupBy("key", "span").agg(*several, F.min(F.struct("row", "at", "size", "n")).alias("place")), "repeat-passage-spans")
        held_by = written(alike.groupBy("key").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1"), "repeat-passage-seeds")
        unlike = alike.join(held_by, "key").select("place.row", "key", "span", F.col("place.at").alias("lo"), "place.size", "place.n", "spans", "first", "last")

    # bytes of the spans that share a seed with others, from one of the texts that hold each
    wanted = spans.where("spans > 1")
    if index is not None:  # those of hot seeds are dealt anew
        known = index.levels.select(F.col("key").alias("k"), F.col("span").alias("s"))
        wanted = wanted.where(F.col("spans") > hot).unionByName(wanted.where(F.col("spans") <= hot).join(known, (F.col("key") == F.col("k")) & (F.col("span") == F.col("s")), "left_anti"))
    fields = ("key", "span", "lo", "size", "n", "left", "c", "spans", "first", "last")
    # spans of words have a first and a last row, spans of bytes don't
    none = lambda *names: {c: F.lit(None).cast("int" if c == "left" else "long") for c in names}
    wanted = wanted.withColumns({"size": F.col("n") - 1 + length} | none("first", "last")).select("row", *fields)
    if passages:
        wanted = wanted.unionByName(unlike.withColumns(none("left", "c")).select("row", *fields))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("wanted"))

    def slices(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in few_rows(batches):
            out = []
            for z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack(z)
                out += [(w["key"], w["span"], w["n"], w["left"], w["c"], text[w["lo"] : w["lo"] + w["size"]], w["spans"], w["first"], w["last"]) for w in wanted]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "span", "n", "left", "c", "bytes", "spans", "first", "last"])

    sliced = every_text.join(wanted, "row").select("z", "wanted").mapInArrow(slices, f"{SPANS}, spans long, first long, last long")
    sliced = written(sliced, "repeat-bytes")
    found, levels = resolved(sliced.where("first is null").drop("first", "last"), length, hot, levels=None if index is None else index.levels)
    # equal spans occur twice by themselves, whatever else they share
    flags = found.where("flags is not null").unionByName(spans.where("c >= 2").select("key", "span", F.lit(None).cast("binary").alias("flags")))
    marks = rows.where(F.col("row") >= base).join(flags, ["key", "span"]).groupBy("row").agg(F.collect_set(F.struct("lo", "n", "flags")).alias("marks"))

    with_marks = texts.join(marks, "row", "left")
    if passages:
        by_words = sliced.where("first is not null")
        offsets = passage_offsets(by_words.where(F.col("spans") <= hot), passages)
        if (held_by.agg(F.max("spans")).first()[0] or 0) > hot:
            windows = written(passage_windows(by_words.where(F.col("spans") > hot), passages), "repeat-passage-windows")
            shared = written(windows.groupBy("words").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("words"), "repeat-passage-shared")
            offsets = offsets.unionByName(windows.where("first = last").join(shared, "words", "left_semi").groupBy("key", "span").agg(F.collect_set("offset").alias("offsets")))
        # spans of several rows are shared as a whole
        offsets = offsets.unionByName(alike.where("first < last").select("key", "span", F.lit(None).cast("array<int>").alias("offsets")))
        covered = runs.where(F.col("row") >= base).join(offsets, ["key", "span"]).groupBy("row").agg(F.collect_set(F.struct("lo", "n", "offsets")).alias("passages"))
        with_marks = with_marks.join(covered, "row", "left")
    else:
        with_marks = with_marks.withColumn("passages", F.lit(None).cast("array<struct<lo: int, n: int, offsets: array<int>>>"))

    def passage_words(marks: list | None) -> int:
        """Words under windows of ``passages`` words."""
        starts = np.unique(np.concatenate([m["lo"] + np.array(range(m["n"]) if m["offsets"] is None else m["offsets"], np.int64) for m in marks])) if marks else []
        return int(np.minimum(np.diff(starts), passages).sum()) + passages if len(starts) else 0

    def remove(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in few_rows(batches):
            out = []
            for z, marks, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                text = unpack(z)
                shared = passage_words(runs)
                gone, pieces = 0, 0
                if marks:
                    edge = np.zeros(len(text) + 1, np.int32)
                    for m in marks:
                        at = np.arange(m["n"]) if m["flags"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["flags"], np.uint8), count=m["n"]))
                        np.add.at(edge, m["lo"] + at, 1)
                        np.add.at(edge, m["lo"] + at + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone, pieces = int(covered.sum()), int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                else:
                    kept = text
                out.append((len(text), gone, pieces, hashlib.sha256(kept).hexdigest(), shared, kept if keep_text else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"])

    done = with_marks.select("doc_id", "z", "marks", "passages").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")
    done = done.drop(*([] if passages else ["n_passage_words"]), *([] if keep_text else ["kept"]))
    # what this load wrote: its own spans, and those it met; all others stay where they are
    load = 0 if index is None else 1 + (index.levels.agg(F.max("load")).first()[0] or 0)
    added = {"texts": texts, "anchors": anchors, "levels": levels.withColumn("load", F.lit(load))}
    grown = RepeatIndex(every_text, anchors, added["levels"], added)
    if index is not None:
        grown = RepeatIndex(every_text, index.anchors.unionByName(anchors), index.levels.unionByName(added["levels"]), added)
    return done, grown


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT, keep_text: bool = False, passages: int | None = None) -> DataFrame:
    """``add_load`` of all documents at once."""
    return add_load(docs, None, length, seed, hot, keep_text, passages)[0]


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without the 400-byte strings that occur again; and its words in passages of over 50 words that others hold."""
    return without_repeats(table(spark, sf_dir, "documents"), passages=PASSAGE)

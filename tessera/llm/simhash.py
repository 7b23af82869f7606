"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits; bit b is set where more than half of its word
shingles' XXH64 values have it set. Two fingerprints are linked at ``TAU`` or
fewer differing bits, and linked documents form groups (connected components).

Pigeonring filter: the fingerprint is a ring of four 16-bit segments. If two
fingerprints differ in at most tau bits, some segment starts a chain whose
cumulative differences stay within the proportional budgets tau/4, 2 tau/4,
3 tau/4 and tau. For tau = 3 that means: an equal segment, then at most 1, 2 and
3 differences. Candidates therefore share a segment and, up to one bit, the
next. Each distinct fingerprint is listed under 4 x 16 keys (segment, next
segment without one bit); those that share a key are checked for the whole chain
before the full distance.

Keys with many fingerprints are cut into chunks; each pair of chunks is a task's
work, so no group has to fit one task. A task reports links that connect what is
not yet connected, not all pairs. Copies have one fingerprint and count once.

Defined results: null text is empty; texts without words have fingerprint 0 and
are linked like any other; null doc_ids take part and never name a group unless
all of it is null; repeated rows stay, each with its group; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes, with_columns_from, written

SEED, TAU, SEGMENTS, SEGMENT_BITS = 42, 3, 4, 16
#: Fingerprints under one key that one task compares at once.
CHUNK = 2048
_BITS_AT_ONCE = 1 << 17


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= shingle:
            values = [digest(line, SEED)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.append(0, ends[: n - shingle]).tolist()
            values = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        h = np.array(values, np.uint64)
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), _BITS_AT_ONCE):
            part = h[at : at + _BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * count > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, "doc_id long, fp long")


def chain_within(diff: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Which XORs of fingerprints have a prefix-viable chain around the ring and at most ``tau`` bits."""
    seg = np.stack([np.bitwise_count((diff >> np.uint64(SEGMENT_BITS * i)) & np.uint64(0xFFFF)) for i in range(SEGMENTS)]).astype(np.int64)
    viable = np.zeros(diff.shape, bool)
    for first in range(SEGMENTS):
        total, ok = np.zeros(diff.shape, np.int64), np.ones(diff.shape, bool)
        for length in range(1, SEGMENTS + 1):
            total = total + seg[(first + length - 1) % SEGMENTS]
            ok &= total * SEGMENTS <= length * tau
        viable |= ok
    return viable & (np.bitwise_count(diff) <= tau)


def _links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, tau: int) -> tuple[list, list]:
    """Links within runs of equal ``group``; small runs by shifted comparison, large ones by growing components."""
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(cut, len(group)))
    left, right = [], []
    rank = np.arange(len(group)) - np.repeat(cut, size)
    small = np.repeat(size, size) <= 64
    for step in range(1, int(size[size <= 64].max(initial=1))):
        a = np.flatnonzero(small[:-step] & (rank[step:] >= step) & (group[:-step] == group[step:]))
        a = a[chain_within(fp[a] ^ fp[a + step], tau)]
        left.append(fp[a])
        right.append(fp[a + step])
    for at, n in zip(cut[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        # the run's fingerprints are distinct: each one taken from the front claims its neighbours among those left
        rest, front = np.unique(fp[at : at + n]), []
        while len(rest) or front:
            if not front:
                front, rest = [rest[0]], rest[1:]
            v = front.pop()
            near = chain_within(rest ^ v, tau) if len(rest) else np.zeros(0, bool)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), v, np.uint64))
                right.append(found)
                front.extend(found)
                rest = rest[~near]
    return left, right


def fingerprint_links(distinct: DataFrame, tau: int = TAU, chunk: int = CHUNK) -> DataFrame:
    """Links a < b (signed) that join all distinct fingerprints ``fp`` within ``tau`` bits; some links inside a joined group may be left out."""
    if tau > 3:
        raise ValueError("the keys hold for 3 differing bits at most")
    key = F.expr(f"(v << 32) | ((shiftrightunsigned(fp, cast({SEGMENT_BITS} * (v div 16) as int)) & 65535) << 16) | (shiftrightunsigned(fp, cast({SEGMENT_BITS} * ((v div 16 + 1) % {SEGMENTS}) as int)) & 65535 & ~(1L << cast(v % 16 as int)))")
    keyed = distinct.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(16 * SEGMENTS - 1).cast("long"))).alias("v")).select("fp", "v", key.alias("key"))
    # tables of keys are written first: a join of two plain tables can split a hot key, one with an aggregate below it can't
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    keyed = keyed.join(shared, "key")
    # what is left of a hot key are two segments with 3 differences at most: one of their four quarters is equal
    quarter = F.expr(f"shiftrightunsigned(fp, cast({SEGMENT_BITS} * ((v div 16 + 2 + q div 2) % {SEGMENTS}) + 8 * (q % 2) as int)) & 255")
    hot = keyed.where(F.col("n") > chunk).select("fp", "v", "key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    hot = written(hot.select("fp", F.xxhash64("key", "q", quarter).alias("key")), "hot-keys")
    cut = written(hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks")), "hot-chunks")
    keyed = keyed.where(F.col("n") <= chunk).select("key", "fp", F.lit(1).cast("long").alias("chunks")).unionByName(hot.join(cut, "key").select("key", "fp", "chunks"))
    shared = keyed.select("key", "fp", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    shared = shared.select("key", "fp", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"))

    def run(batches):
        held = None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)) for i in range(4)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            new = np.flatnonzero((rows[[0, 2, 3], 1:] != rows[[0, 2, 3], :-1]).any(0)) + 1
            # the last run may go on in the next batch; a run has two chunks at most
            at = new[-1] if len(new) else 0
            held = rows[:, at:]
            if at:
                yield from emit(rows[:, :at])
        if held is not None and held.shape[1]:
            yield from emit(held)

    def emit(rows):
        group = np.cumsum(np.append(0, (rows[[0, 2, 3], 1:] != rows[[0, 2, 3], :-1]).any(0)))
        left, right = _links(group, np.ascontiguousarray(rows[1]).view(np.uint64), rows[2], tau)
        if left and sum(map(len, left)):
            pairs = np.stack([np.concatenate(left), np.concatenate(right)]).view(np.int64)
            pairs = np.unique(np.sort(pairs, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    dealt = shared.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "fp").select("key", "fp", "c1", "c2")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for each node of ``links`` (a, b).

    Alternates large-star and small-star steps: each links neighbours to the
    smallest neighbour of a node, until every component is a star. All steps are
    aggregates and joins; tables are written between them, so that a join can split
    a node that all others of a large component are linked to.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "links-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of its group) of each row."""
    own = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = written(components(fingerprint_links(distinct.select("fp"), tau)), "roots")
    grouped = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "grouped")
    named = written(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    return own.join(grouped.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WIDE_WORDS, WIDE_SHINGLE, SIMILARITY = 4, 5, 0.8
#: Keys of a text: each joins so many minima of its shingles' hash values. Two texts at ``SIMILARITY`` share a key with probability 0.995.
KEYS, MINIMA = 18, 6
_ROUNDS = np.array([(0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(WIDE_WORDS)], np.uint64)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 32, (KEYS * MINIMA, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The XXH64 values of a text's word shingles, each once, in order; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, n)
    starts = np.append(0, ends[: n - k]).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def wide_bits(h: np.ndarray) -> bytes:
    """256 bits over a set of shingles; each shingle's value is mixed anew for each 64 of them."""
    count = np.zeros(64 * WIDE_WORDS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1 << 14):
            x = h[at : at + (1 << 14), None] + _ROUNDS
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            count += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * count > len(h)).tobytes()


def keys_of(h: np.ndarray) -> np.ndarray:
    """``KEYS`` keys of a set of shingles: hash values of ``MINIMA`` minima each, a function of its own for every minimum."""
    import xxhash

    if not len(h):
        return np.zeros(0, np.int64)
    folded = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        x = folded[None, at : at + 4096] * _ODD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, x.min(1))
    return np.array([xxhash.xxh64_intdigest(least[i * MINIMA : (i + 1) * MINIMA].tobytes(), i) for i in range(KEYS)], np.uint64).view(np.int64)


def loose_tau(n: np.ndarray) -> np.ndarray:
    """Bits of 256 above those of nearly any pair at ``SIMILARITY``: 39 are expected there, 5.7 is the deviation; very small sets all pass."""
    return np.where(n < 24, 64 * WIDE_WORDS, 60)


def chained(diff: np.ndarray, tau: np.ndarray, chain: int) -> np.ndarray:
    """Which rows of segment differences have ``chain`` consecutive segments around the ring whose cumulative differences stay within their proportional budgets.

    A row within ``tau`` bits in all has such a chain of any length.
    """
    m = diff.shape[1]
    budget = (np.arange(1, chain + 1)[:, None] * tau // m).astype(np.int16)
    total = diff.astype(np.int16)
    viable = total <= budget[0][:, None]
    for length in range(2, chain + 1):
        total = total + np.roll(diff, 1 - length, axis=1)
        viable &= total <= budget[length - 1][:, None]
    return viable.any(1)


def wide_within(a: np.ndarray, b: np.ndarray, tau: np.ndarray, chain: int = 8) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (16-bit segments) are within ``tau`` bits: only pairs with a chain get the full check."""
    diff = np.bitwise_count(a ^ b)
    near = chained(diff, tau, chain)
    near[near] = diff[near].sum(1, dtype=np.int64) <= tau[near]
    return near


def may_be_alike(na: np.ndarray, nb: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Which pairs of sets, by their sizes and fingerprints, may be at ``SIMILARITY``."""
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    ok = 100 * least >= round(100 * SIMILARITY) * most
    ok[ok] = wide_within(fa[ok], fb[ok], loose_tau(least[ok]))
    return ok


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILARITY`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= round(100 * SIMILARITY) * (len(a) + len(b) - both)


def _segments(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, 4 * WIDE_WORDS)


#: Segments of a chain that decides which candidates get a distance.
CHAIN = 3
#: Candidates of a text that are verified: of the ends of its keys, and of the nearest in other groups.
ENDS, NEAREST = 3, 4
_PAIRS = "a long, b long, d long"
#: Bytes of sets, about, in each of the two chunks of a key that a task of the exact search holds.
CHUNK_BYTES = 4 << 20


def _few(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest candidates b of each a, as pairs a < b."""
    near = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "b"))), 1, most).alias("near"))
    near = near.select("a", F.explode("near.b").alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs of each id (id, fp, n, keys) with the nearest of the first and the last id under each of its keys: few pairs, which join most of a large group."""
    keyed = distinct.select("id", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    ends = written(ends.select("key", F.explode(F.array("first", "last")).alias("end")), "dedup-ends")
    pairs = keyed.join(ends, "key").where("id <> end").select("id", "end").distinct()
    left, right = (distinct.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fp").alias(f"fp_{x}")) for x in ("id", "end"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fa, fb = _segments(batch.column(4)), _segments(batch.column(5))
                ok = may_be_alike(np.asarray(batch.column(2)), np.asarray(batch.column(3)), fa, fb)
                d = np.bitwise_count(fa ^ fb).sum(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[ok]), pa.array(np.asarray(batch.column(1))[ok]), pa.array(d[ok])], ["a", "b", "d"])

    met = pairs.join(left, "id").join(right, "end").select("id", "end", "n_id", "n_end", "fp_id", "fp_end")
    return _few(met.mapInArrow(run, _PAIRS), ENDS)


def nearest_pairs(distinct: DataFrame, tried: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs of each id (id, fp, n, keys, root) with the nearest under its keys that are of another root.

    Ids of the root that is most frequent under a key wait for the others. Keys
    with more ids than ``chunk`` are cut, so that the work is linear in the rows.
    """
    keyed = distinct.select("id", "root", F.explode("keys").alias("key"))
    open_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_keys = written(open_keys.select("key", F.ceil(F.col("m") / chunk).cast("long").alias("chunks")), "dedup-keys")
    dealt = keyed.join(open_keys, "key").select("key", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("part"), "id", "root")
    dealt = dealt.join(distinct.select("id", "fp", "n"), "id").select("key", "part", "id", "root", "n", "fp")

    def run(batches):
        held = None
        for batch in batches:
            rows, fps = np.stack([np.asarray(batch.column(i)) for i in range(5)]), _segments(batch.column(5))
            if held is not None:
                rows, fps = np.concatenate([held[0], rows], axis=1), np.concatenate([held[1], fps])
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0)) + 1
            at = new[-1] if len(new) else 0
            held = rows[:, at:], fps[at:]
            if at:
                yield from emit(rows[:, :at], fps[:at])
        if held is not None and held[0].shape[1]:
            yield from emit(*held)

    def emit(rows, fps):
        cut = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0))).tolist()
        found = []
        for begin, end in zip(cut, [*cut[1:], rows.shape[1]], strict=True):
            ids, root, n = rows[2:, begin:end]
            roots, count = np.unique(root, return_counts=True)
            if len(roots) < 2:
                continue
            segments = fps[begin:end]
            for i in np.flatnonzero(root != roots[np.argmax(count)]).tolist():
                others = np.flatnonzero(root != root[i])
                least, most = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                sized = 100 * least >= round(100 * SIMILARITY) * most
                others, tau = others[sized], loose_tau(least[sized])
                diff = np.bitwise_count(segments[others] ^ segments[i])
                # chains prune before any distance is added up
                near = np.flatnonzero(chained(diff, tau, CHAIN))
                d = diff[near].sum(1, dtype=np.int64)
                near, d = near[d <= tau[near]], d[d <= tau[near]]
                # some may have been tried before
                first = np.argsort(d, kind="stable")[: NEAREST + 2 * ENDS]
                found.append(np.stack([np.full(len(first), ids[i]), ids[others[near[first]]], d[first]]))
        if found:
            found = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "d"])

    met = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(run, _PAIRS)
    known = tried.select(F.col("a").alias("x"), F.col("b").alias("y"))
    met = met.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    return _few(met, NEAREST)


def _runs(batches, parts: int, together: bool = False):
    """Whole runs of rows that agree in their first ``parts`` columns, from sorted batches, as Arrow tables; ``together``: those of a batch in one."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = np.stack([rows.column(i).to_numpy() for i in range(parts)])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
        # the last run may go on in the next batch
        held, ends = rows.slice(cut[-1]), [0, cut[-1]] if together and cut[-1] else cut
        for begin, end in itertools.pairwise(ends):
            yield rows.slice(begin, end - begin)
    if held is not None and held.num_rows:
        yield held


def _paired(keyed: DataFrame, chunks: DataFrame) -> DataFrame:
    """``keyed`` (key, id) under each pair c1 <= c2 of chunks of its key (key, chunks) that has its own chunk, ``mine``."""
    mine = F.pmod(F.xxhash64("id"), F.col("chunks"))
    dealt = keyed.join(chunks, "key").select("key", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return dealt.select("key", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "id", "mine")


class _Rows:
    """Rows of pairs of chunks of keys (key, c1, c2): who may be alike with whom.

    Two texts that share several keys are compared under the first of them only.
    """

    def __init__(self, rows: pa.Table):
        col = lambda c: rows.column(c).to_numpy()
        self.run = np.stack([col("key"), col("c1"), col("c2")])
        self.ids, self.root, self.n, self.mine = col("id"), col("root").copy(), col("n"), col("mine")
        self.fps = _segments(rows.column("fp"))
        self.keys = np.concatenate([x.flatten().to_numpy() for x in rows.column("keys").chunks]).reshape(-1, KEYS)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows ``a`` and ``b`` of one run are of different roots, compared here, and may be alike."""
        # pairs of one chunk are compared where that chunk stands alone
        ok = (self.root[a] != self.root[b]) & ((self.run[1, a] == self.run[2, a]) | (self.mine[a] != self.mine[b]))
        x, y = a[ok], b[ok]
        first = (self.keys[x] == self.keys[y]).argmax(1)
        here = self.keys[x, first] == self.run[0, x]
        here[here] = may_be_alike(self.n[x[here]], self.n[y[here]], self.fps[x[here]], self.fps[y[here]])
        ok[ok] = here
        return ok


def in_question(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key and id of those ids (id, fp, n, keys, root) that may be at ``SIMILARITY`` with one of another root under that key: no pairs are made."""
    keyed = distinct.select("id", "root", F.explode("keys").alias("key"))
    # keys with one text, or with texts that are joined already, have nothing to add
    open_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_keys = written(open_keys.select("key", F.ceil(F.col("m") / chunk).cast("long").alias("chunks")), "dedup-keys")
    dealt = _paired(keyed.select("key", "id"), open_keys).join(distinct, "id").select("key", "c1", "c2", "id", "mine", "root", "n", "fp", "keys")

    def run(batches):
        for rows in _runs(batches, 3, together=True):
            own, asked = _Rows(rows), np.zeros(rows.num_rows, bool)
            group = np.cumsum(np.append(0, (own.run[:, 1:] != own.run[:, :-1]).any(0)))
            first = np.arange(len(group))
            for step in range(1, int(np.bincount(group).max())):
                # runs shorter than the step fall out
                first = first[first + step < len(group)]
                first = first[group[first] == group[first + step]]
                # of two that are known to be in question the pair is not asked for
                a = first[~(asked[first] & asked[first + step])]
                a = a[own.may_link(a, a + step)]
                asked[a] = asked[a + step] = True
            if asked.any():
                yield pa.RecordBatch.from_arrays([pa.array(own.run[0, asked]), pa.array(own.ids[asked])], ["key", "id"])

    return dealt.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "id").mapInArrow(run, "key long, id long").distinct()


def links_between(asked: DataFrame, distinct: DataFrame, texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Links that join all pairs of ``asked`` (key, id) of different roots at ``SIMILARITY`` under a key, by whole sets of shingles.

    A task compares two chunks of a key, whose sets it holds, and gives on only the
    links that join what it has not joined yet: fewer than it has rows, however
    many pairs it compares.
    """
    whole = _sets(asked.select("id").distinct(), texts)
    weight = F.sum(8 * F.col("n") + chunk_bytes // CHUNK)
    chunks = written(asked.join(distinct.select("id", "n"), "id").groupBy("key").agg(F.ceil(weight / chunk_bytes).cast("long").alias("chunks")), "dedup-chunks")
    dealt = _paired(asked, chunks).join(distinct, "id").join(whole, "id").select("key", "c1", "c2", "id", "mine", "root", "n", "fp", "keys", "h")

    def run(batches):
        for rows in _runs((part for batch in batches for part in small_batches([batch], 9)), 3):
            own, at = _Rows(rows), np.append(0, np.cumsum(rows.column("n").to_numpy()))
            # shingles of the run are numbered, so that one text meets all others by a look-up
            number = np.unique(np.frombuffer(b"".join(rows.column("h").to_pylist()), np.uint64), return_inverse=True)[1].astype(np.int32)
            marked, left, right = np.zeros(int(number.max(initial=-1)) + 1, bool), [], []
            for i in range(rows.num_rows - 1):
                near = np.arange(i + 1, rows.num_rows)
                near = near[own.may_link(np.full(len(near), i), near)]
                if not len(near):
                    continue
                mine = number[at[i] : at[i + 1]]
                marked[mine] = True
                both = np.array([np.count_nonzero(marked[number[at[j] : at[j + 1]]]) for j in near.tolist()])
                marked[mine] = False
                near = near[100 * both >= round(100 * SIMILARITY) * (own.n[i] + own.n[near] - both)]
                # one link for each root is enough
                for j in near.tolist():
                    if own.root[j] != own.root[i]:
                        left.append(own.ids[i])
                        right.append(own.ids[j])
                        own.root[own.root == own.root[j]] = own.root[i]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    return written(dealt.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "id").mapInArrow(run, "a long, b long"), "dedup-links")


def _sets(needed: DataFrame, texts: DataFrame) -> DataFrame:
    """id and h, the whole set of shingles, of those of ``texts`` (id, text) that are ``needed`` (id)."""

    def sets(batches):
        for batch in batches:
            for part in small_batches([batch], 1):
                h = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.binary())], ["id", "h"])

    whole = texts.join(needed, "id", "left_semi").select("id", text_bytes().alias("t")).mapInArrow(sets, "id long, h binary")
    return written(whole, "dedup-sets")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (id, text) are at ``SIMILARITY``, by their whole sets of shingles."""
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def check(batches):
        for batch in batches:
            for part in small_batches([batch], 2):
                both = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                ok = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    whole = _sets(needed, texts)
    left, right = (whole.select(F.col("id").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long"), "dedup-links")


def similar_links(distinct: DataFrame, texts: DataFrame, exhaustive: bool = True) -> DataFrame:
    """Links that join the distinct texts (id, fp, n, keys) at ``SIMILARITY`` that share a key; links inside a joined group may be left out.

    Each text first meets others of its keys' ends, so that large groups are
    joined by few links, then the nearest ones of other groups, so that few pairs
    are left; then ``exhaustive`` compares all that are, inside its tasks. That work
    grows with the square of a group of texts just below ``SIMILARITY``, rows with
    the group and its number of chunks. Without it two groups stay apart if all
    their links are between texts that each have ``NEAREST`` nearer candidates which
    fail.
    """

    def rooted(links):
        roots = written(components(links), "dedup-roots")
        return written(distinct.join(roots, F.col("id") == F.col("node"), "left").select("id", "fp", "n", "keys", F.coalesce("root", "id").alias("root")), "dedup-rooted")

    tried = written(star_pairs(distinct), "dedup-pairs")
    links = verified(tried, texts)
    links = links.unionByName(verified(written(nearest_pairs(rooted(links), tried), "dedup-pairs"), texts))
    if exhaustive:
        left = rooted(links)
        links = links.unionByName(links_between(written(in_question(left), "dedup-asked"), left, texts))
    return links


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, exhaustive: bool = True) -> DataFrame:
    """Pipeline stage: one row of each group of near copies, that with the smallest doc_id.

    Near copies have a similarity of 0.8 or more over sets of five-word shingles;
    texts without words are copies of each other. Null doc_ids come last in a
    group; repeated rows are copies; an empty table stays empty.
    """

    def make():
        from pyspark import TaskContext

        at = [TaskContext.get().partitionId() << 40]

        def run(texts):
            import xxhash

            begin, at[0] = at[0], at[0] + len(texts)
            sets = [shingle_set(t.encode()) for t in texts]
            keys = pa.array([keys_of(h) for h in sets], pa.list_(pa.int64()))
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            return [pa.array(np.arange(begin, at[0])), pa.array([wide_bits(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), same, keys]

        return run

    rows, names = with_columns_from(docs, "text", make, [("uid", "long"), ("fp", "binary"), ("n", "long"), ("same", "binary"), ("keys", "array<long>")])
    rows, uid = written(rows, "dedup-rows"), names[0]
    own = rows.select(*[F.col(c).alias(x) for c, x in zip(names, ("uid", "fp", "n", "same", "keys"), strict=True)], F.col("doc_id").cast("long").alias("doc_id"))
    # equal sets go by the smallest of their rows' ids; order: doc_id (nulls last), then row
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    sets = own.groupBy("same").agg(F.min(order).alias("first"), F.min("uid").alias("id"))
    distinct = written(sets.select("id", "first").join(own.select(F.col("uid").alias("id"), "fp", "n", "keys"), "id"), "dedup-distinct")
    links = similar_links(distinct.select("id", "fp", "n", "keys"), rows.select(F.col(uid).alias("id"), "text"), exhaustive)
    roots = written(components(links), "dedup-roots")
    grouped = distinct.select("id", "first").join(roots, F.col("id") == F.col("node"), "left")
    keep = grouped.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.uid").alias("kept_uid"))
    return rows.join(keep, rows[uid] == keep["kept_uid"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every whole text of ``documents`` (3-word shingles, 3 bits)."""
    return near_duplicates(table(spark, sf_dir, "documents"))

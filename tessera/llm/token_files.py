"""Token ids in patched frame-of-reference blocks.

``encode_tables`` writes the ids of all documents, in ascending doc_id order, as
rows of shards; ``read_documents`` reads them back. A shard is one binary value:

    "PFR1", ids in all (u32), blocks (u32)
    start of each block, and the end of the last (u32 each)
    blocks: minimum (u32), width (u8), exceptions (u8), 128 differences packed at
    that width, positions of the exceptions (u8 each), their differences (u32 each)

A block's width is that of a percentile of its differences, so that a few large
ones don't widen the rest; these are the exceptions. The index of block starts
gives any run of ids without reading the blocks before it (``ids_between``).

Defined results: null text is empty, and an empty text is its end id alone; null
doc_ids come first; rows that share a doc_id follow each other by two hashes of the
text, in the same order for any split of the input; an empty table gives no shards.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back_memory, small_batches, table, worker_state, written

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 0.9
SHARD_IDS, END_ID = 1 << 18, 0
#: Bytes of text that one task encodes, and those that are encoded at once.
TASK_BYTES, GROUP_BYTES = 16 << 20, 6 << 20
#: A worker keeps the ids of new words until it has so many (about 30 MB); others are encoded when they come up.
MEMO = 800_000
TOKENIZER = "byte_bpe_50k.json"


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One shard of ``ids`` (unsigned 32-bit)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head + bytes(4)
    grid = np.pad(ids.astype(np.uint32), (0, blocks * BLOCK - n), mode="edge").reshape(blocks, BLOCK)
    low = grid.min(1)
    diff = grid - low[:, None]
    bits = lambda v: np.ceil(np.log2(v + 1.0)).astype(np.int64)  # noqa: E731  exact below 2**48
    width = bits(np.sort(diff, 1)[:, int(np.ceil(percentile * BLOCK)) - 1])
    over = diff > ((1 << width) - 1).astype(np.uint32)[:, None]
    n_over = over.sum(1)
    start = np.cumsum(np.append(0, 6 + width * (BLOCK // 8) + 5 * n_over))
    out = np.zeros(start[-1], np.uint8)
    at = start[:-1, None]
    out[at + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at[:, 0] + 4], out[at[:, 0] + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        kind = ">u2" if w <= 16 else ">u4"
        flags = np.unpackbits(diff[own].astype(kind).view(np.uint8).reshape(len(own), BLOCK, -1), axis=2)[:, :, -w:]
        out[at[own] + 6 + np.arange(w * BLOCK // 8)] = np.packbits(flags.reshape(len(own), -1), axis=1)
    if n_over.any():
        b, pos = np.nonzero(over)
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        tail = start[b] + 6 + width[b] * (BLOCK // 8)
        out[tail + nth] = pos
        out[(tail + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = diff[b, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + start.astype("<u4").tobytes() + out.tobytes()


def ids_between(shard: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (excluded) of a shard; only the blocks that hold them are unpacked."""
    assert shard[:4] == MAGIC, "not a shard"
    n, blocks = np.frombuffer(shard, "<u4", 2, 4).tolist()
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    start = np.frombuffer(shard, "<u4", b1 - b0 + 1, 12 + 4 * b0).astype(np.int64)
    data = np.frombuffer(shard, np.uint8, -1, 12 + 4 * (blocks + 1))
    at = start[:-1, None]
    low = data[at + np.arange(4)].copy().view("<u4").astype(np.int64)
    width, n_over = data[at[:, 0] + 4].astype(np.int64), data[at[:, 0] + 5].astype(np.int64)
    grid = np.zeros((b1 - b0, BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        kind, full = (">u2", 16) if w <= 16 else (">u4", 32)
        flags = np.zeros((len(own), BLOCK, full), np.uint8)
        flags[:, :, -w:] = np.unpackbits(data[at[own] + 6 + np.arange(w * BLOCK // 8)], axis=1).reshape(len(own), BLOCK, w)
        grid[own] = np.packbits(flags, axis=2).view(kind)[:, :, 0]
    if n_over.any():
        b = np.repeat(np.arange(b1 - b0), n_over)
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        tail = start[:-1][b] + 6 + width[b] * (BLOCK // 8)
        grid[b, data[tail + nth]] = data[(tail + n_over[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (grid + low).astype(np.uint32).ravel()[first - b0 * BLOCK : last - b0 * BLOCK]


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file says that its pieces never reach over a space before a word: byte-level BPE with the usual pattern, on the text as it is."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cutter, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    spaced = any(" " in t["content"] or "\n" in t["content"] or t.get("lstrip") or t.get("rstrip") for t in said.get("added_tokens") or [])
    return bool(plain and not spaced and said.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout"))


class WordEncoder:
    """Ids of whole texts from a tokenizer; word by word from a byte-level BPE one, which merges within words only.

    A space before a non-space character begins a new word for such a tokenizer,
    and a single line end between two of them is a word, so a text's ids are those
    of its pieces, cut there. Arrow cuts a group of texts and numbers its distinct
    pieces, so that each is looked up once; the ids of known pieces are kept in flat
    arrays. A text with spaces elsewhere is cut by a pattern instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_spaces(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(0, np.int64)
        self.cut = re.compile(r"(?= \S)")
        # ids of pieces that begin with a space, as byte-level tokenizers write it
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for piece, i in self.tokenizer.get_vocab().items() if piece[:1] == "\u0120"]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        # in slices, as the library's result objects are large
        return [e.ids for i in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def words_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and their numbers, of words without white space at their ends, each after a space.

        They are encoded as one line, whose pieces that begin with a space begin
        the words: no result object for each word.
        """
        flat, lengths = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids = np.array(self.encode([f" {' '.join(some)}"])[0], self.kind)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) == len(some):
                flat.append(ids)
                lengths.append(np.diff(np.append(begin, len(ids))))
            else:  # a word that holds a piece with a space of its own
                each = self.encode([f" {w}" for w in some])
                flat += [np.array(x, self.kind) for x in each]
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(lengths)

    def table_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each of the distinct ``words``: its row; and of all rows: the flat ids, their numbers, and the odd ones."""
        row = pc.index_in(words, value_set=self.words)
        missing = np.flatnonzero(row.is_null().to_numpy(zero_copy_only=False))
        row = pc.fill_null(row, 0).to_numpy().astype(np.int64)
        kept = len(self.words)
        new = words.take(pa.array(missing)).to_pylist()
        bare = [w[1:] if w[:1] == "\n" else w for w in new]
        odd = np.array([not b or b != b.strip() for b in bare], bool)
        apart = odd | np.array([w[:1] == "\n" for w in new], bool)
        # plain words come first in the flat table; rows of the others follow
        plain, other = np.flatnonzero(~apart), np.flatnonzero(apart)
        flat, lengths = self.words_of([new[i] for i in plain.tolist()])
        found = self.encode([new[i] if new[i][:1] == "\n" else f" {new[i]}" for i in other.tolist()])
        more = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(found), self.kind, int(more.sum()))])
        lengths, order = np.concatenate([lengths, more]), np.concatenate([plain, other])
        missing, odd = missing[order], odd[order]
        row[missing] = kept + np.arange(len(missing))
        ids, n = np.concatenate([self.ids, flat]), np.concatenate([self.lengths, lengths])
        if kept < MEMO and not odd.any():
            self.words, self.ids, self.lengths = pa.concat_arrays([self.words, words.take(pa.array(missing))]), ids, n
        elif kept < MEMO:
            plain = np.flatnonzero(~odd)
            self.words = pa.concat_arrays([self.words, words.take(pa.array(missing[plain]))])
            self.ids, self.lengths = np.concatenate([self.ids, flat[np.repeat(~odd, lengths)]]), np.concatenate([self.lengths, lengths[plain]])
        return row, ids, n, np.concatenate([np.zeros(kept, bool), odd])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(ids, np.uint32) for ids in self.encode(texts)]
        # a piece after a line end keeps it, in place of a space
        marked = pa.array([t.replace(" \n", "  \n") if "\n\n" in t else t.replace("\n", " \n") for t in texts], pa.large_string())
        lists = pc.split_pattern(marked, " ")
        pieces, counts = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
        at_first = np.cumsum(counts) - counts
        rest = np.ones(len(pieces), bool)
        rest[at_first] = False
        firsts = pieces.take(pa.array(at_first)).to_pylist()
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        row, ids, n, odd = self.table_of(coded.dictionary)
        row = row[coded.indices.to_numpy()]
        size = n[row]
        ends = np.cumsum(size)
        # places in the flat table; a group has far fewer than 2**31 ids
        at = np.repeat(((np.cumsum(n) - n)[row] - ends + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        flat = ids[at]
        word_end = np.cumsum(counts - 1)
        bound = np.append(0, ends)[np.append(0, word_end)]
        unusual = set(np.searchsorted(word_end, np.flatnonzero(odd[row]), side="right").tolist())
        unusual |= {i for i, p in enumerate(firsts) if counts[i] > 1 and p != p.rstrip()}
        out = []
        for i, first in enumerate(self.encode(firsts)):
            if i in unusual:
                own = [x for part in self.encode([x for x in self.cut.split(texts[i]) if x]) for x in part]
                out.append(np.array(own, np.uint32))
            else:
                out.append(np.concatenate([np.array(first, np.uint32), flat[bound[i] : bound[i + 1]]]))
        return out


SHARDS = "part int, seq int, part_offset long, n_ids long, doc_ids array<long>, doc_lengths array<long>, shard binary"


def encode_tables(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Shards of the ids of ``docs`` (doc_id, text) in ascending doc_id order.

    The documents are range-partitioned by doc_id, so each task writes one run of
    the whole order. ``part_offset`` counts the ids of a task before the shard;
    a document never crosses a shard.
    """

    def encode(batches):
        import public_tokenizers

        path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
        words = worker_state("encoder_" + re.sub(r"\W", "_", path), lambda: WordEncoder(path))
        part = TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("shard", pa.binary())])
        names, ids, held, seq, before = [], [], 0, 0, 0

        def shard():
            row = [[part], [seq], [before], [held], [names], [[len(x) for x in ids]], [pack_blocks(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in small_batches(batches, 1, GROUP_BYTES):
            for key, own in zip(batch.column(0).to_pylist(), words.batch(batch.column(1).to_pylist()), strict=True):
                names.append(key)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
                if held >= shard_ids:
                    yield shard()
                    seq, before = seq + 1, before + held
                    names, ids, held = [], [], 0
        if names:
            yield shard()
        give_back_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // task_bytes))
    # rows of one id, or of none, are in the order of their texts' hashes; equal rows may be cut anywhere
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.spark_partition_id().alias("dealt"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("h1").asc(), F.col("h2").asc(), F.col("dealt").asc())
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(encode, SHARDS)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_blocks of each document, from the shards alone."""

    def read(batches):
        for batch in batches:
            for part, offset, keys, lengths, shard in zip(*(batch.column(c).to_pylist() for c in ("part", "part_offset", "doc_ids", "doc_lengths", "shard")), strict=True):
                ids = ids_between(shard).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts + offset), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "part_offset", "doc_ids", "doc_lengths", "shard").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one number for each task that wrote: ids before it
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, before = {}, 0
    for row in totals:
        base[row["part"]], before = before, before + row["n"]
    if not base:
        return docs.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")
    first = docs.sparkSession.createDataFrame(sorted(base.items()), "part int, base long")
    return docs.join(first, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the shards of ``docs`` into the shared folder and describe each document from them."""
    return read_documents(written(encode_tables(docs), "op8-shards"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, written in shards and read back."""
    return token_digests(table(spark, sf_dir, "documents"))

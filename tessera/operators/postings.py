"""Which rows hold a word: postings and frequencies, kept by signed changes.

Postings (word, ids, n) lie in partitions by a checksum of the word, sorted by word,
so that a search opens the partitions of its words and skips the rest of each file.
A load holds differences only: blocks of ids that now have a word (``n`` is their
number), and blocks of those that lost it (``n`` is minus their number). Blocks are
packed where the rows are read, so that a word is shuffled and sorted once a block,
not once a row; tasks that write a part join the blocks of a word and sum them up. A
word's frequency is the sum of its differences, kept apart so that counting reads no
postings, and so is the number of rows. ``fold`` adds differences up.

The words of a row are its terms by ``terms``: words for ranked search, groups of
three letters for the search of literal strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.generations import Generations

BUCKETS = 64
SCHEMA = "word string, ids array<long>, n long"
#: Postings that a task packs into blocks at once, and those of a word above which ``fold`` shares it among tasks.
AT_ONCE, HOT = 1 << 21, 1 << 20
#: Ids from which a block is not joined to the next.
BLOCK = 1 << 16


def _blocks(words: pa.Array, ids: pa.Array, n: int) -> pa.RecordBatch:
    """One row a word with its ids; ``n`` is 1 or -1."""
    coded = words.dictionary_encode()
    order = np.argsort(codes := np.asarray(coded.indices), kind="stable")
    cut = np.flatnonzero(np.diff(codes[order], prepend=-1))
    held = pa.ListArray.from_arrays(pa.array(np.append(cut, len(order)).astype(np.int32)), ids.take(pa.array(order)))
    sizes = np.diff(np.append(cut, len(order)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[order][cut])), held, pa.array(n * sizes)], ["word", "ids", "n"])


def packed(rows: DataFrame) -> DataFrame:
    """Blocks (word, ids, n) of rows (id, now, was): words that each row gets, and those that it loses."""

    def run(batches):
        for batch in batches:
            for at, n in ((1, 1), (2, -1)):
                column = batch.column(at)
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))
                begin = 0
                while begin < batch.num_rows:
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right")))
                    some = column.slice(begin, end - begin)
                    words = some.flatten()
                    if len(words):
                        yield _blocks(words, batch.column(0).slice(begin, end - begin).take(pc.list_parent_indices(some)), n)
                    begin = end

    return rows.select("id", "now", "was").mapInArrow(run, SCHEMA)


def joined(rows: DataFrame, buckets: int) -> DataFrame:
    """Sorted blocks (word, ids, n, part) with those of a word that lie together as one, losses and gains apart, and a word's sums, ``buckets`` parts on."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, held, n, part = batch.columns
            sizes, n, part = np.asarray(pc.list_value_length(held), np.int64), np.asarray(n), np.asarray(part)
            begins = np.cumsum(sizes) - sizes
            new_word = np.diff(np.asarray(words.dictionary_encode().indices), prepend=-1) != 0
            cut = np.flatnonzero(new_word | (np.diff(np.sign(n), prepend=0) != 0) | (np.diff(begins // BLOCK, prepend=0) != 0))
            ids = pa.ListArray.from_arrays(pa.array(np.append(begins[cut], sizes.sum()).astype(np.int32)), held.flatten())
            names = ["word", "ids", "n", "part"]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(cut)), ids, pa.array(np.add.reduceat(n, cut)), pa.array(part[cut])], names)
            cut = np.flatnonzero(new_word)
            sums = np.add.reduceat(n, cut)
            cut, sums = cut[sums != 0], sums[sums != 0]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(cut)), pa.nulls(len(cut), held.type), pa.array(sums), pa.array(part[cut] + np.int32(buckets))], names)

    return rows.select("word", "ids", "n", "part").mapInArrow(run, f"{SCHEMA}, part int")


def summed(rows: DataFrame) -> DataFrame:
    """Blocks of what is left of blocks that are dealt and sorted by word: ids whose differences add up to one."""

    def add_up(table):
        words = table.column("word").combine_chunks()
        coded = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
        held = table.column("ids").combine_chunks()
        sizes = np.asarray(pc.list_value_length(held), np.int64)
        code, sign = np.repeat(np.asarray(coded.indices), sizes), np.repeat(np.sign(np.asarray(table.column("n"))), sizes)
        flat = held.flatten()
        # a null id comes first
        known = np.asarray(pc.fill_null(flat, 0))
        null = np.asarray(pc.is_null(flat), bool)
        order = np.lexsort((known, ~null, code))
        code, known, null, sign = code[order], known[order], null[order], sign[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (known[1:] != known[:-1]) | (null[1:] != null[:-1])))
        left = first[np.add.reduceat(sign, first) > 0] if len(first) else first
        if len(left):
            yield _blocks(coded.dictionary.take(pa.array(code[left])), pa.array(known[left], mask=null[left]), 1)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += int(np.abs(np.asarray(batch.column(2))).sum())
            if rows < AT_ONCE:
                continue
            # the last word may go on in the next batch
            table = pa.concat_tables(held).combine_chunks()
            going_on = np.asarray(pc.equal(table.column("word"), table.column("word")[-1]), bool)
            at = int(np.flatnonzero(going_on)[0])
            if at:
                yield from add_up(table.slice(0, at))
            held = [table.slice(at)]
            rows = int(np.abs(np.asarray(held[0].column("n"))).sum())
        if held:
            yield from add_up(pa.concat_tables(held).combine_chunks())

    return rows.select("word", "ids", "n").mapInArrow(run, SCHEMA)


def distinct_words(content: Column) -> Column:
    return F.array_distinct(text.words(content))


def trigrams(content: Column) -> Column:
    """All groups of three characters in lower case, each once; a shorter text has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigrams_of(term: str) -> list[str]:
    low = term.lower()
    return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))


class Postings:
    """Postings, frequencies and the number of rows, in one folder and with one switch a load."""

    def __init__(self, spark: SparkSession, path: str, terms: Callable[[Column], Column] = distinct_words, buckets: int = BUCKETS):
        # postings in parts 0 to buckets - 1, frequencies in the next, the number of rows in the last
        self.table, self.terms, self.buckets = Generations(spark, path, SCHEMA), terms, buckets

    def _bucket(self, word: str) -> int:
        return zlib.crc32(word.encode()) % self.buckets

    def _bucket_of(self) -> Column:
        return F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(self.buckets)).cast("int")

    def differences(self, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        """Blocks (word, ids, n): what changes where rows ``old`` (id, content) become ``new``.

        Ids only in ``old`` are removed, those only in ``new`` added; one row an id
        on each side. A null text has no words.
        """
        none = F.array().cast("array<string>")
        held = lambda name: F.array_compact(F.coalesce(self.terms(F.col(name)), none)).alias(name)
        text_of = lambda df, name: df.select("id", F.col("content").alias(name))
        if new is None:
            return packed(text_of(old, "was").select("id", held("was"), none.alias("now")))
        if old is None:
            return packed(text_of(new, "now").select("id", held("now"), none.alias("was")))
        # texts meet, which are smaller than their words
        both = text_of(old, "was").join(text_of(new, "now"), "id", "full").select("id", held("was"), held("now"))
        return packed(both.select("id", F.array_except("now", "was").alias("now"), F.array_except("was", "now").alias("was")))

    def _stage(self, blocks: DataFrame) -> str:
        """Blocks and the sums of their words, which the same tasks write."""
        return self.table.stage(blocks.withColumn("part", self._bucket_of()), "word", "n", then=lambda rows: joined(rows, self.buckets))

    def _stage_total(self, n: int) -> str:
        return self.table.stage(self.table.spark.createDataFrame([("", None, n, 2 * self.buckets)], f"{SCHEMA}, part int"), "word")

    def update(self, old: DataFrame | None, new: DataFrame | None, grown: int | None = None) -> int:
        """A load: rows that changed, as they were and as they are now. All or nothing of it is seen by searches.

        ``grown`` is by how much the number of rows grows, where the caller knows it.
        """
        rows = self._stage(self.differences(old, new))
        if grown is None:
            grown = (new.count() if new is not None else 0) - (old.count() if old is not None else 0)
        return self.table.commit([rows, self._stage_total(grown)])

    def fold(self) -> int:
        """One load with all differences added up in place of those that were there.

        Tasks add up whole words; the ids of a word with more than ``HOT`` postings
        are shared among them.
        """
        blocks = self.table.read(range(self.buckets))
        hot = [r["word"] for r in blocks.groupBy("word").agg(F.sum(F.abs("n")).alias("n")).where(F.col("n") > HOT).select("word").collect()]
        few = blocks.where(~F.col("word").isin(hot)) if hot else blocks
        sums = summed(few.repartition("part", "word").sortWithinPartitions("word"))
        if hot:
            one = self._exploded(blocks.where(F.col("word").isin(hot)))
            sums = sums.unionByName(packed(one.select("id", F.array("word").alias("now"), F.array().cast("array<string>").alias("was"))))
        return self.table.commit([self._stage(sums), self._stage_total(self.total())], range(2 * self.buckets + 1))

    @staticmethod
    def _exploded(blocks: DataFrame) -> DataFrame:
        """word and id of what is left of blocks."""
        rows = blocks.select("word", F.explode("ids").alias("id"), F.signum("n").cast("long").alias("n"))
        return rows.groupBy("word", "id").agg(F.sum("n").alias("n")).where("n > 0").select("word", "id")

    def total(self) -> int:
        """Number of rows."""
        return self.table.read([2 * self.buckets]).agg(F.sum("n")).first()[0] or 0

    def frequencies(self, words: list[str] | None = None, version: int | None = None) -> DataFrame:
        """word and n_chunks, of all words or of ``words``, now or as of a load: postings are not read."""
        parts = range(self.buckets, 2 * self.buckets) if words is None else {self._bucket(w) + self.buckets for w in words}
        rows = self.table.read(parts, version)
        if words is not None:
            rows = rows.where(F.col("word").isin(words))
        return rows.groupBy("word").agg(F.sum("n").alias("n_chunks")).where("n_chunks > 0")

    def postings(self, words: list[str]) -> DataFrame:
        """word and id of the rows that hold each of ``words``."""
        return self._exploded(self.table.read({self._bucket(w) for w in words}).where(F.col("word").isin(words)))

    def all_postings(self, words: DataFrame | None = None) -> DataFrame:
        """word and id of all rows, or of ``words`` (word): those select blocks before any is opened up."""
        blocks = self.table.read(range(self.buckets))
        return self._exploded(blocks if words is None else blocks.join(words.select("word"), "word", "left_semi"))

    def scores(self, query: str, divisor: int, pool: DataFrame, fallback: bool = False) -> DataFrame:
        """id and score of the rows of ``pool`` with a rare word of the query: the summed rarity of all its words in them.

        Rare words select first; postings of frequent words are kept for those rows only.
        """
        words, total = text.analyse(query), self.total()
        weights, rare = text.term_weights(self.frequencies(words), words, total, divisor, fallback)
        if not rare:
            return self.table.spark.createDataFrame([], "id long, score double")
        weight = F.lit(0.0)
        for word, w in weights:
            weight = F.when(F.col("word") == word, F.lit(w)).otherwise(weight)
        found = self.postings(rare).join(pool.select("id"), "id", "left_semi")
        other = [w for w in words if w not in rare]
        if other:
            found = found.unionByName(self.postings(other).join(found.select("id").distinct(), "id", "left_semi").select("word", "id"))
        return found.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))

    def best(self, query: str, k: int, divisor: int, pool: DataFrame, fallback: bool = False) -> DataFrame:
        """The k best rows of ``scores`` with their rank."""
        top = self.scores(query, divisor, pool, fallback).orderBy(F.desc("score"), "id").limit(k)
        return top.selectExpr("id", "score", "row_number() over (order by score desc, id) as rank")


class Literals(Postings):
    """Rows that contain a string literally: groups of three letters select, the text decides."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, rarest: int = 4):
        super().__init__(spark, path, trigrams, buckets)
        self.rarest = rarest

    def containing(self, chunks: DataFrame, term: str) -> DataFrame:
        """Rows of ``chunks`` that contain ``term``, whatever the case.

        Rows that hold the rarest groups of the term are looked at; a term of less
        than three letters needs a scan.
        """
        exact = text.contains(F.col("content"), term)
        grams = trigrams_of(term)
        if not grams:
            return chunks.where(exact)
        known = {r["word"]: r["n_chunks"] for r in self.frequencies(grams).collect()}
        if len(known) < len(grams):  # a group that no row has
            return chunks.where(F.lit(False))
        chosen = sorted(grams, key=lambda g: (known[g], g))[: self.rarest]
        held = self.postings(chosen)
        ids = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("id") if len(chosen) > 1 else held.select("id")
        return chunks.join(ids, "id", "left_semi").where(exact)


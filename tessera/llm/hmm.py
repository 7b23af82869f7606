"""Hidden Markov language model over whole texts.

Words are emitted in two steps: a state emits a word class, and the class emits
the word by its share of the training counts, smoothed as in the base model:

    P(word | class) = (count + 0.5) / (count of class + 0.5 (words of class + 1))

The most frequent words, ``OWN`` at most, are classes of their own; every other word is in
a class by its ending, so that unseen words still tell of a state. The model's
size is thus fixed, while counts are kept for every word of the corpus.

Training: Baum-Welch. Each task runs the scaled forward and backward recursions
over its texts, whole ones, and emits expected counts; Spark adds them up. They
are added as whole numbers, so that reruns agree. Long texts run as blocks side by
side that exact operators link (``Blocks``): no text is one long loop. Scoring: the scaled forward
recursion gives a text's exact likelihood under the model.

Counts of rare words reach the texts by a join on the word: no table that grows
with the corpus is broadcast or collected.

Defined results: null text is empty; an empty text is its end token alone; a
null doc_id counts as the empty string for the split; without training texts
every token has base probability 1 and the model is uniform over classes;
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes, written

STATES, ROUNDS, OWN, ENDINGS = 6, 6, 16_384, 16_384
END = b""
SCALE = 1 << 20
#: Texts of more tokens than this are cut into blocks that run side by side.
LONG = 1 << 15
_FLUSH, _CELLS, _PIECE = 300_000, 1 << 19, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(text: bytes):
    """The words of a text with A-Z lowered, in lists of some MB of text, and the end token (the empty word)."""
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, at + _PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end].lower().split()
        at = end
    yield [END]


def held_out():
    """Rows that are not learned from: crc32 of the doc_id's text leaves 1 modulo 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c (its count) over the training texts."""

    def run(batches):
        counts: Counter = Counter()
        for batch in small_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                for words in word_lists(text):
                    counts.update(words)
                    if len(counts) > _FLUSH:
                        yield flush(counts)
                        counts = Counter()
        if counts:
            yield flush(counts)

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])

    return docs.where(~held_out()).select(text_bytes().alias("t")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """The words with classes of their own, and figures of each class."""

    own: dict[bytes, tuple[int, float]]  # class and log10(count + 0.5)
    log_share: np.ndarray  # log10 of what divides a word's count in its class
    class_counts: np.ndarray
    n: int
    v: int


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes from the table of counts; only the most frequent words and sums by class reach the driver."""
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    # the count from which words are frequent enough: bins of counts, a thousand at most, whatever the corpus
    size = F.floor(F.log2("c") * 16).cast("int")
    bins = {r["size"]: r["words"] for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, taken = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        taken += bins[b]
        if taken > OWN:
            break
        least = b
    top = sorted(counts.where(size >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    own = {bytes(r["word"]): (i, math.log10(r["c"] + 0.5)) for i, r in enumerate(top)}
    names = set(own)

    def run(batches):
        for batch in batches:
            rest = [(ending_class(w), c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in names]
            if rest:
                cls, c = np.array(rest, np.int64).T
                size = np.bincount(cls, minlength=OWN + ENDINGS)
                total = np.zeros(OWN + ENDINGS, np.int64)
                np.add.at(total, cls, c)
                at = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(size[at])], ["cls", "c", "v"])

    total, size = np.zeros(OWN + ENDINGS), np.zeros(OWN + ENDINGS)
    for r in counts.mapInArrow(run, "cls long, c long, v long").groupBy("cls").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        total[r["cls"]], size[r["cls"]] = r["c"], r["v"]
    for i, r in enumerate(top):
        total[i], size[i] = r["c"], 1
    return Vocabulary(own, np.log10(total + 0.5 * (size + 1)), total, n or 0, v or 0)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as classes (two bytes a token), with its rare words and their times in it."""
    own = vocab.own

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 2):
            texts = batch.column(2).to_pylist()
            classes, n, logs, rare_words, rare_times, ends = [], [], [], [], [], [0]
            for text in texts:
                rare: Counter = Counter()
                parts, size, log = [], 0, 0.0
                for words in word_lists(text):
                    size += len(words)
                    cls = []
                    for w in words:
                        known = own.get(w)
                        if known is None:
                            rare[w] += 1
                            cls.append(ending_class(w))
                        else:
                            cls.append(known[0])
                            log += known[1]
                    parts.append(np.array(cls, "<u2").tobytes())
                classes.append(b"".join(parts))
                n.append(size - sum(rare.values()))
                logs.append(log)
                rare_words += rare.keys()
                rare_times += rare.values()
                ends.append(len(rare_words))
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["w", "n"])
            arrays = [pa.array(np.arange(uid, uid + len(texts))), pa.array(classes, pa.binary()), pa.array(n, pa.int64()), pa.array(logs, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            uid += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "held_out", "uid", "cls", "own_n", "own_log", "rare"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, uid long, cls binary, own_n long, own_log double, rare array<struct<w: binary, n: long>>")


@dataclass
class Hmm:
    """Start, transition and class probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    def laid_out(self) -> Hmm:
        """The same with arrays of its own, row by row: one that has travelled to a task may lie otherwise, and reading columns of it is slow."""
        return Hmm(*(np.array(x, order="C") for x in (self.start, self.move, self.emit)))

    @staticmethod
    def initial(class_counts: np.ndarray, states: int = STATES) -> Hmm:
        """Sticky states whose classes differ by fixed random factors."""
        prior = class_counts + 0.5
        noise = np.exp(np.random.default_rng(5).normal(0, 0.5, (states, len(prior))))
        emit = prior * noise
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95)
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Hmm:
        """The next model from expected counts, smoothed by a little of the corpus's own class shares."""
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        start, move, emit = start + 0.1, move + 0.1, emit + 50.0 * share
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _padded(texts: list[np.ndarray]):
    """Groups of texts of like length: their numbers, lengths in falling order, and classes [time, text]."""
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        part = order[at : at + max(1, min(4096, _CELLS // longest))]
        lengths = np.array([len(texts[i]) for i in part])
        grid = np.zeros((longest, len(part)), np.int64)
        for j, i in enumerate(part):
            grid[: len(texts[i]), j] = texts[i]
        yield np.array(part), lengths, grid
        at += len(part)


def _active(lengths: np.ndarray, steps: int) -> list[int]:
    return np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right").tolist()


def forward(model: Hmm, grid: np.ndarray, lengths: np.ndarray, prior: np.ndarray | None = None, keep: bool = False):
    """Scaled forward recursion: ln likelihood of each text, and if asked the scaled alphas, emissions [time, state, text] and scales.

    ``prior`` are the states' probabilities before each text, if it goes on from an earlier block.
    """
    steps, width = grid.shape
    back, k = np.ascontiguousarray(model.move.T), len(model.start)
    scales = np.ones((steps, width))
    alphas, emits = (np.zeros((steps, k, width)) if keep else None for _ in range(2))
    a = model.start[:, None] if prior is None else prior.T
    for t, m in enumerate(_active(lengths, steps)):
        e = model.emit.take(grid[t, :m], axis=1)
        a = (a if t == 0 else back @ a[:, :m]) * e
        s = a.sum(0)
        a /= s
        scales[t, :m] = s
        if keep:
            alphas[t, :, :m], emits[t, :, :m] = a, e
    return np.log(scales).sum(0), alphas, emits, scales


def expected_counts(model: Hmm, grid: np.ndarray, lengths: np.ndarray, prior: np.ndarray | None = None, after: np.ndarray | None = None):
    """Baum-Welch counts of a group of texts: first states of each, moves, classes by state, its ln likelihood, and what each text's first token weighs.

    ``after`` are scaled betas at the texts' ends, if they go on in later blocks.
    """
    loglik, alphas, emits, scales = forward(model, grid, lengths, prior, keep=True)
    steps, width = grid.shape
    k = len(model.start)
    moves, beta = np.zeros((k, k)), np.ones((k, width))
    if after is not None:
        beta *= after.T
        alphas[lengths - 1, :, np.arange(width)] *= after
    active = _active(lengths, steps)
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        ahead = emits[t + 1, :, :m] * beta[:, :m]
        ahead /= scales[t + 1, :m]
        now = alphas[t, :, :m]
        moves += now @ ahead.T
        beta[:, :m] = model.move @ ahead
        now *= beta[:, :m]
    first = emits[0] * beta / scales[0]
    real = np.arange(steps)[:, None] < lengths
    cls = grid[real]
    counts = np.stack([np.bincount(cls, alphas[:, i][real], model.emit.shape[1]) for i in range(k)])
    return alphas[0].T, moves * model.move, counts, loglik.sum(), first.T


class Blocks:
    """A long text as blocks that run side by side.

    Each block's operator, the product of its steps, is found first. It carries
    the states from block to block, forwards and backwards, so that each block
    can then run by itself from the right start and with the right end: sums are
    those of the whole text, and no more than a group of blocks is held at once.
    """

    def __init__(self, model: Hmm, text: np.ndarray, step: int | None = None):
        self.model, n = model, len(text)
        self.step = step or max(256, math.isqrt(n))
        self.count = -(-n // self.step)
        padded = np.zeros(self.count * self.step, np.uint16)
        padded[:n] = text
        self.grid = padded.reshape(self.count, self.step).T
        self.lengths = np.minimum(self.step, n - self.step * np.arange(self.count))
        width = max(1, _CELLS // self.step)
        self.slices = [slice(a, min(a + width, self.count)) for a in range(0, self.count, width)]
        self.operators = np.concatenate([self._operators(s) for s in self.slices])
        k = len(model.start)
        self.prior, self.end = np.empty((self.count, k)), np.empty((self.count, k))
        p = model.start
        for b in range(self.count):
            self.prior[b] = p
            a = p @ self.operators[b]
            self.end[b] = a / a.sum()
            p = self.end[b] @ model.move

    def _operators(self, s: slice) -> np.ndarray:
        """States at a block's end by states at its start, up to a factor."""
        model, lengths = self.model, self.lengths[s]
        k = len(model.start)
        a = np.broadcast_to(np.eye(k), (len(lengths), k, k)).copy()
        for t, m in enumerate(_active(lengths, self.step)):
            part = (a[:m] if t == 0 else (a[:m].reshape(-1, k) @ model.move).reshape(-1, k, k)) * model.emit.take(self.grid[t, s][:m], axis=1).T[:, None]
            a[:m] = part / part.sum((1, 2), keepdims=True)
        return a

    def loglik(self) -> float:
        return float(sum(forward(self.model, self.grid[:, s], self.lengths[s], self.prior[s])[0].sum() for s in self.slices))

    def counts(self):
        """Baum-Welch counts of the text: start, moves, classes by state, and its ln likelihood."""
        model = self.model
        after, z = np.empty_like(self.end), np.ones(len(model.start))
        for b in range(self.count - 1, -1, -1):
            after[b] = z / (self.end[b] @ z)
            z = model.move @ (self.operators[b] @ after[b])
        start, moves, emits, total = None, 0.0, 0.0, 0.0
        for s in self.slices:
            first, m, e, loglik, ahead = expected_counts(model, self.grid[:, s], self.lengths[s], self.prior[s], after[s])
            start = first[0] if start is None else start
            skip = 1 if s.start == 0 else 0
            across = self.end[s.start + skip - 1 : s.stop - 1].T @ ahead[skip:]
            moves, emits, total = moves + m + across * model.move, emits + e, total + loglik
        return start, moves, emits, total


def summed(parts: DataFrame, names: list[str]) -> DataFrame:
    """Sums by id of the tasks' whole numbers, as decimals: those of a large corpus pass the largest long."""
    return parts.groupBy("id").agg(*[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names])


def baum_welch_round(texts: DataFrame, model: Hmm, class_counts: np.ndarray) -> tuple[Hmm, float]:
    """One round over all training texts: the next model and ln likelihood under this one."""
    k, classes = model.emit.shape

    def run(batches):
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
        own = model.laid_out()
        for batch in small_batches(batches, 0, 32 << 20):
            texts = [np.frombuffer(t, "<u2") for t in batch.column(0).to_pylist()]
            for _, lengths, grid in _padded([t for t in texts if len(t) <= LONG]):
                a, b, c, d, _ = expected_counts(own, grid, lengths)
                start, move, emit, total = start + a.sum(0), move + b, emit + c, total + d
            for text in texts:
                if len(text) > LONG:
                    a, b, c, d = Blocks(own, text).counts()
                    start, move, emit, total = start + a, move + b, emit + c, total + d
        seen = np.flatnonzero(emit.any(0))
        rows = np.concatenate([emit[:, seen].T, start[None], move, np.full((1, k), total)])
        ids = np.concatenate([seen, classes + np.arange(k + 2)])
        whole = np.rint(rows * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(whole[:, i]) for i in range(k)]], ["id", *[f"s{i}" for i in range(k)]])

    names = [f"s{i}" for i in range(k)]
    got = np.zeros((classes + k + 2, k))
    for r in summed(texts.mapInArrow(run, ", ".join(["id long", *[f"{n} long" for n in names]])), names).collect():  # one row for each class, state and total
        got[r["id"]] = [float(r[n] / SCALE) for n in names]
    return model.updated(got[classes], got[classes + 1 : classes + 1 + k], got[:classes].T, class_counts), float(got[-1, 0])


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch on the encoded training rows; also ln likelihood before each round."""
    texts, model, seen = rows.where("not held_out").select("cls"), Hmm.initial(vocab.class_counts, states), []
    for _ in range(rounds if vocab.n else 0):
        model, loglik = baum_welch_round(texts, model, vocab.class_counts)
        seen.append(loglik)
    return model, seen


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    counts = written(word_counts(docs), "hmm-counts")
    vocab = vocabulary(counts)
    rows = written(encoded(docs, vocab), "hmm-encoded")
    model, _ = train(rows, vocab, states, rounds)
    share, floor = vocab.log_share, math.log10(vocab.n + 0.5 * (vocab.v + 1))

    def run(batches):
        own = model.laid_out()
        for batch in small_batches(batches, 3, 32 << 20):
            texts = [np.frombuffer(t, "<u2") for t in batch.column(3).to_pylist()]
            hmm, by_class, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            short = np.array([i for i, t in enumerate(texts) if len(t) <= LONG], np.int64)
            for part, lengths, grid in _padded([texts[i] for i in short]):
                hmm[short[part]] = forward(own, grid, lengths)[0]
            for i, text in enumerate(texts):
                n[i], by_class[i] = len(text), share[text].sum()
                if len(text) > LONG:
                    hmm[i] = Blocks(own, text).loglik()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), batch.column(5), pa.array(n), pa.array(hmm / math.log(10) - by_class)], ["doc_id", "held_out", "uid", "own_n", "own_log", "n_tokens", "model_part"])

    scored = rows.select("doc_id", "held_out", "uid", "cls", "own_n", "own_log").mapInArrow(run, "doc_id long, held_out boolean, uid long, own_n long, own_log double, n_tokens long, model_part double")
    rare = rows.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.w").alias("w"), F.col("r.n").alias("n"))
    rare = rare.join(counts, rare["w"] == counts["word"], "left").select("uid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_n"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_log"))
    logs = F.col("own_log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        # words with classes of their own occur in the training texts
        (F.col("own_n") + F.coalesce("rare_n", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (logs + F.col("model_part")).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learned from four fifths of them."""
    return score_documents(table(spark, sf_dir, "documents"))

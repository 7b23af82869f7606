"""The hidden Markov model against direct sums over all state sequences, and its scores against plain counts."""

import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm

DOCS = "doc_id long, text string, score string"


def small_model(rng, states=3, classes=5):
    r = lambda *s: rng.random(s) + 0.05
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Hmm(norm(r(states)), norm(r(states, states)), norm(r(states, classes)))


def paths(model, seq):
    k = len(model.start)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[b, c]
        yield path, p


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    seqs = [rng.integers(0, 5, n).astype("<u2") for n in (1, 2, 4, 6, 6, 3)]
    start, move, emit, total, likely = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0, {}
    for i, s in enumerate(seqs):
        every = list(paths(model, s))
        z = sum(p for _, p in every)
        likely[i], total = math.log(z), total + math.log(z)
        for path, p in every:
            start[path[0]] += p / z
            for a, b in zip(path, path[1:]):
                move[a, b] += p / z
            for a, c in zip(path, s):
                emit[a, c] += p / z
    got = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0]
    for part, lengths, grid in hmm._padded(seqs):
        for i, x in zip(part, hmm.forward(model, grid, lengths)[0]):
            assert x == pytest.approx(likely[i], rel=1e-12)
        a, b, c, d, _ = hmm.expected_counts(model, grid, lengths)
        got = [x + y for x, y in zip(got, (a.sum(0), b, c, d))]
    for a, b in zip(got, (start, move, emit, total)):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    # the same in blocks, of a token each and more
    for step in (1, 2, 3):
        got = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0]
        for i, s in enumerate(seqs):
            blocks = hmm.Blocks(model, s, step)
            assert blocks.loglik() == pytest.approx(likely[i], rel=1e-12)
            got = [x + y for x, y in zip(got, blocks.counts())]
        for a, b in zip(got, (start, move, emit, total)):
            np.testing.assert_allclose(a, b, rtol=1e-9)


def test_blocks_of_a_long_text_agree_with_one_run(monkeypatch):
    rng = np.random.default_rng(2)
    model, text = small_model(rng), rng.integers(0, 5, 5003).astype("<u2")
    ((_, lengths, grid),) = hmm._padded([text])
    want = hmm.expected_counts(model, grid, lengths)
    monkeypatch.setattr(hmm, "_CELLS", 3000)  # several groups of blocks
    for step in (None, 64):
        for a, b in zip(hmm.Blocks(model, text, step).counts(), (want[0].sum(0), *want[1:4])):
            np.testing.assert_allclose(a, b, rtol=1e-8)


def test_a_million_words_in_seconds():
    rng = np.random.default_rng(2)
    model, text = hmm.Hmm.initial(rng.integers(1, 1000, 32768)), rng.integers(0, 32768, 1_000_000).astype("<u2")
    began = time.time()
    start, move, emit, loglik = hmm.Blocks(model, text).counts()
    assert time.time() - began < 10
    assert start.sum() == pytest.approx(1) and move.sum() == pytest.approx(len(text) - 1) and emit.sum() == pytest.approx(len(text))
    assert hmm.Blocks(model, text, 5000).loglik() == pytest.approx(loglik)


def test_sums_beyond_a_long(spark):
    df = spark.createDataFrame([(1, 2**62 + 1, -(2**62)), (1, 2**62, -(2**62)), (1, 2**62, -(2**62)), (2, 5, 6)], "id long, s0 long, s1 long")
    got = {r["id"]: (int(r["s0"]), int(r["s1"])) for r in hmm.summed(df, ["s0", "s1"]).collect()}
    assert got == {1: (3 * 2**62 + 1, -3 * 2**62), 2: (5, 6)}


def test_words_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(hmm, "_PIECE", 7)
    text = "Some wörds\x0bOF\x1c all   kinds\n and averyveryverylongone ".encode()
    assert [w for part in hmm.word_lists(text) for w in part] == [*text.lower().split(), b""]


def texts():
    rng = np.random.default_rng(5)
    left, right = [f"le{i}" for i in range(30)], [f"ri{i}" for i in range(30)]
    docs = [" ".join(rng.choice(left if i % 2 else right, int(rng.integers(1, 40)))) for i in range(150)]
    return [*docs, None, "", "  \n", "UNSEEN wörds Only here", "a\x0bB c", "x " * 5000]


def test_scores(spark):
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(7, "Le1 ri1", None), (7, "Le1 ri1", None), (None, "le1", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = hmm.score_documents(df, states=2, rounds=8).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [b""]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t, _ in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    gain = [r for r in out if r["held_out"] and 10 < r["n_tokens"] < 100]
    assert sum(r["score"] for r in gain) > sum(r["base_score"] for r in gain) + 5
    again = hmm.score_documents(df, states=2, rounds=8).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)


def test_model_is_a_distribution(spark):
    """Probabilities of all one-word texts, with one unseen word in each class, sum to 1 with the end token left out."""
    learned = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame([(i, t, "") for i, t in zip(learned, ("a b a", "b c", "a"))], DOCS)
    counts = hmm.written(hmm.word_counts(df), "test")
    vocab = hmm.vocabulary(counts)
    assert vocab.n == 9 and vocab.v == 4
    model, seen = hmm.train(hmm.written(hmm.encoded(df, vocab), "test"), vocab, 2, 5)
    assert all(b >= a - 1e-3 for a, b in zip(seen[1:], seen[2:]))
    np.testing.assert_allclose(model.emit.sum(1), 1)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    mass = np.zeros(len(vocab.class_counts))
    for w, n in c.items():
        k = vocab.own[w][0] if w in vocab.own else hmm.ending_class(w)
        mass[k] += (n + 0.5) / 10 ** vocab.log_share[k]
    np.testing.assert_allclose(mass + 0.5 / 10**vocab.log_share, 1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], DOCS)
    assert hmm.score_documents(df).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = hmm.score_documents(spark.createDataFrame([(lone, "a b", "")], DOCS)).collect()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["n_known"] == 0 and row["score"] < 0

"""Toxicity on held-out rows, tiling against a brute-force cover, and the pipeline's stages."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as dc
from tessera.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long, p_toxic string"


def labelled(n, seed):
    rng = random.Random(seed)
    neutral = [f"word{i}" for i in range(300)]
    bad = ["idiocy", "idiotic", "scumbag", "trashy", "trash"]
    docs, labels = [], []
    for i in range(n):
        k = rng.choice([0, 0, 0, 1, 4])
        words = rng.choices(neutral, k=rng.randrange(10, 60)) + rng.choices(bad, k=k)
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", 0, None))
        labels.append((i, 1, int(k > 0)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(1500, 1)
    df = spark.createDataFrame(docs, DOCS)
    model = tx.train(df, spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    out, (severity, p, grade) = tx.severity(df, model)
    assert p == "_p_toxic" and model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = {r["doc_id"]: r for r in out.collect()}
    truth = {i: t for i, _, t in labels}
    right = sum((rows[i][p] >= 0.5) == bool(truth[i]) for i in range(1000, 1500))
    assert right >= 470
    mild = [rows[i][severity] for i in range(1000, 1500) if truth[i] and sum(w in docs[i][1] for w in ("idio", "scum", "trash")) == 1]
    worst = [rows[i][severity] for i in range(1000, 1500) if truth[i] and sum(docs[i][1].count(w) for w in ("idio", "scum", "trash")) == 4]
    assert 0.5 < np.mean(mild) < np.mean(worst) <= 2
    assert {r[grade] for r in rows.values()} == {0, 1, 2}


def test_gradient_matches_likelihood():
    """Weights that Adam finds are a stationary point of the penalised likelihood."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    s = x @ np.array([2.0, -1.0, 0.0])
    grade = (s + rng.logistic(size=400) > 0).astype(int) + (s + rng.logistic(size=400) > 2).astype(int)
    row, col = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    model = tx.fit([10, 11, 12], row, col, x.ravel(), grade)
    w, theta = np.array([model.weights[i] for i in (10, 11, 12)]), np.array(model.thresholds)

    def loss(w, theta):
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        sig = lambda t: 1 / (1 + np.exp(-t))
        p = sig(edge[grade + 1] - x @ w) - sig(edge[grade] - x @ w)
        return -np.log(p).mean() + tx.RIDGE / 2 * (w**2).sum()

    base = loss(w, theta)
    for i in range(3):
        for h in (0.05, -0.05):
            assert loss(w + h * np.eye(3)[i], theta) > base - 1e-5


def test_odd_labels(spark):
    docs = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "idiot", "en", "s", 0, None), (3, "a b " * 20000, "en", "s", 0, None), (3, "c", "en", "s", 0, None)]
    df = spark.createDataFrame(docs, DOCS)
    for labels in ([], [(1, 1, 0)], [(None, 1, 1), (9, 1, 1)], [(1, 1, None)], [(1, 0, 1), (1, 0, 0), (3, 1, 0), (3, 1, 0)]):
        model = tx.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        out, (severity, _, _) = tx.severity(df, model)
        rows = out.collect()
        assert len(rows) == 5 and all(0 <= r[severity] <= 2 for r in rows)
    assert tx.severity(df.limit(0), model)[0].collect() == []


def brute_tiles(doc, item, least):
    """Greedy tiling by trying all pairs of positions for the longest run."""
    a, b, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and a[i + n] and b[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return covered
        for k in range(n):
            a[i + k] = b[j + k] = False
        covered += n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(1, 6, int(rng.integers(4, 30)))
    parts = [item[a : a + int(rng.integers(3, 12))] for a in rng.integers(0, len(item), 3)]
    doc = np.concatenate([x for p in parts for x in (rng.integers(1, 6, int(rng.integers(0, 6))), p)])
    spots = np.arange(max(0, len(doc) - 2))
    found = dc.tiles(doc, item, spots, 3)
    assert all((doc[i : i + n] == item[j : j + n]).all() for i, j, n in found)
    assert len({k for i, _, n in found for k in range(i, i + n)}) == sum(n for *_, n in found) == len({k for _, j, n in found for k in range(j, j + n)})
    want = brute_tiles(doc.tolist(), item.tolist(), 3)
    assert sum(n for *_, n in found) == want


def test_tiles_of_repetitive_texts():
    """Time doesn't grow with the pairs of places; counts agree with brute force on small ones."""
    for doc, item in (([1] * 40, [1] * 13), ([1, 2] * 15, [1] * 3 + [1, 2] * 6), ([1, 1, 2] * 9, [2, 1, 1, 1] * 5)):
        got = dc.tiles(np.array(doc), np.array(item), np.arange(len(doc) - 2), 3)
        assert sum(t[2] for t in got) == brute_tiles(doc, item, 3)
    began = time.time()
    for doc, item in (([1] * 20_000, [1] * 500), ([1, 2, 3] * 7000, [1, 2] * 20 + [1, 2, 3] * 150), ([1] * 499 + [2, *[1] * 20_000], [1] * 500)):
        got = dc.tiles(np.array(doc), np.array(item), np.arange(len(doc) - 3))
        assert sum(t[2] for t in got) > 400
    assert time.time() - began < 10


ITEMS = "item_id long, text string, coverage string"


def test_reordered_passages(spark):
    item = "one two three four five six. Seven eight nine ten eleven twelve. alpha beta gamma delta epsilon zeta"
    rows = [(1, f"noise {item} noise"), (2, "ALPHA beta gamma, delta epsilon zeta ... seven eight nine ten eleven twelve / one two three four five six"), (3, "one two three four five six and nothing else"), (4, "one two three seven eight nine alpha beta gamma"), (5, None), (6, ""), (1, f"noise {item} noise"), (None, item), (8, "filler " * 60000 + item)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "z") for i, t in rows], DOCS).withColumnRenamed("p_toxic", "coverage")
    items = spark.createDataFrame([(7, item, ""), (5, item, ""), (1, "too short", ""), (2, None, ""), (3, "", "")], ITEMS)
    out, (cover, item_id, n) = dc.contamination(df, items)
    got = {(r["doc_id"], r[n], r[item_id]) for r in out.collect()}
    assert got == {(1, 2, 5), (2, 2, 5), (3, 0, 5), (4, 0, None), (5, 0, None), (6, 0, None), (None, 2, 5), (8, 2, 5)} and cover == "_coverage"
    blocks = list(dc.item_blocks(items, 100))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 4
    assert dc.contamination(df.limit(0), items)[0].collect() == [] and all(r[n] == 0 for r in dc.contamination(df, items.limit(0))[0].collect())


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=20)), "") for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=30)) + " " + rng.choice(items)[1], "en", "s", 0, None) for i in range(20)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one, names = dc.contamination(df, bench)
    blocks = dc.item_blocks
    monkeypatch.setattr(dc, "item_blocks", lambda items: blocks(items, 500))
    many, _ = dc.contamination(df, bench)
    key = lambda d: sorted((r["doc_id"], round(r[names[0]], 9), r[names[1]], r[names[2]]) for r in d.collect())
    assert key(one) == key(many) and all(r[3] == 1 for r in key(one))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled(200, 2)
    item = "quick brown foxes jump over lazy dogs while seven wizards watch them quietly from afar"
    docs = [d[:5] for d in docs]
    clean = [d for d, (_, _, t) in zip(docs, labels) if not t]
    base = max(clean, key=lambda d: len(d[1]))[1]
    docs += [(1000, base, "en", "s", 0), (1001, base.replace("word", "word", 1) + " tail", "en", "s", 0), (1002, "some words then " + item, "en", None, 0), (1003, None, "en", "t", 0), (1004, "a fresh clean text that no other has", "en", "t", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, kept = dict(pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = kept.columns
    kept = stage["toxicity"](spark, kept, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and len(ids & {i for i, _, t in labels if t}) <= 5 and len(ids) >= 0.95 * (5 + sum(not t for *_, t in labels))
    kept = stage["simhash_dedup"](spark, kept, str(tmp_path))
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {1000, 1001} and len(ids - left) == 2
    kept = stage["decontamination"](spark, kept, str(tmp_path))
    assert left - {r["doc_id"] for r in kept.collect()} == {1002}
    mixed = stage["mixing"](spark, kept, str(tmp_path))
    assert mixed.columns == columns
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == mixed.count() and out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def longest_first(doc, item, m=4):
    """Words covered when the longest common run of free words is marked, again and again."""
    free_doc, free_item, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                best = min(best, (-n, j, i))
        n, j, i = best
        if -n < m:
            return covered
        covered -= n
        free_doc[i : i - n] = free_item[j : j - n] = [False] * -n


def test_passages_that_share_a_boundary_word():
    item = [f"w{i}" for i in range(16)]
    bench = dc.Benchmark([(1, " ".join(item))])
    assert bench.match(" ".join([*item[:6], "x", *item[5:12]])) == [(1, 12 / 16)]
    assert bench.match(" ".join([*item[9:], "x", *item[:10]])) == [(1, 1.0)]
    rng = random.Random(5)
    for _ in range(150):
        item = rng.choices("abcdefgh", k=rng.randrange(4, 30)) if rng.random() < 0.5 else [f"w{i}" for i in range(rng.randrange(8, 40))]
        doc = []
        for _ in range(4):
            at = rng.randrange(len(item))
            doc += item[at : at + rng.randrange(3, 12)] + ["x"] * rng.randrange(2)
        got = dict(dc.Benchmark([(1, " ".join(item))]).match(" ".join(doc)))
        assert got.get(1, 0) == longest_first(doc, item) / len(item)

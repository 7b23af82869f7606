"""Cube sampling: constraints, targets against a brute-force sharing, and reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long"


def shared_out(sizes: list, cap=3.0, weights=(5.0, 2.0, 1.0)):
    """Targets by sharing the excess again, round by round."""
    total, n = float(sum(sizes)), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    target, full = [0.0] * n, [s == 0 for s in sizes]
    rest = total
    while rest > 1e-9 and not all(full):
        open_weight = sum(w[i] for i in range(n) if not full[i])
        share = [0.0 if full[i] else rest * w[i] / open_weight for i in range(n)]
        rest = 0.0
        for i in range(n):
            target[i] += share[i]
            if not full[i] and target[i] >= cap * sizes[i]:
                rest += target[i] - cap * sizes[i]
                target[i], full[i] = cap * sizes[i], True
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 50], [1, 2, 3, 4, 5000], [0, 10, 0, 7], [0, 0], [7]])
def test_targets(spark, sizes):
    rows = [(i, f"s{i:02d}", s, 1) for i, s in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source string, size long, m long")).collect()}
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(shared_out(sizes))


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 500, 400).astype(float)
    hits = np.zeros(400)
    for k in range(200):
        pi = mixing.flight(np.full(400, 0.37), x, np.random.default_rng(k))
        open_ = (pi > 0) & (pi < 1)
        assert open_.sum() <= 2 and pi.sum() == pytest.approx(148) and (pi * x).sum() == pytest.approx((0.37 * x).sum())
        hits += pi
    assert abs(hits.mean() / 200 - 0.37) < 1e-6 and np.abs(hits / 200 - 0.37).max() < 0.2
    same = mixing.flight(np.full(50, 0.5), np.full(50, 3.0), np.random.default_rng(1))
    assert set(same) == {0.0, 1.0} and same.sum() == 25


def test_mix(spark):
    rng = np.random.default_rng(3)
    source = lambda i: None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 4}"
    rows = [(i if i % 97 else None, " ".join(["w"] * int(rng.integers(0, 60))) if i % 41 else None, "en", source(i), 0, 5) for i in range(3000)]
    rows += [rows[7]] * 5
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    sizes = mixing.document_sizes(df)
    out = mixing.sample_mix(sizes, block=100, fan_in=5).collect()
    assert sum(r["m"] for r in out) == len(rows) and all(0 <= r["copies"] <= 3 * r["m"] for r in out)
    by = {}
    for r in out:
        t = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        t[0] += r["copies"] * r["size"]
        t[3] += r["size"] * r["m"]
    for taken, target, size, real in by.values():
        assert size == real and abs(taken - target) <= 3
    again = mixing.sample_mix(mixing.document_sizes(df.repartition(2)), block=100, fan_in=5).collect()
    key = lambda rows: sorted(str((r["doc_id"], r["source"], r["size"], r["k1"], r["copies"])) for r in rows)
    assert key(out) == key(again)
    mixed = mixing.mix_documents(spark, df, "").collect()
    assert len(mixed) == sum(mixing_row["copies"] for mixing_row in mixing.sample_mix(sizes).collect()) and mixed[0].__fields__ == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.sample_mix(mixing.document_sizes(df)).collect() == [] and mixing.mix_documents(spark, df, "").collect() == []


def test_sources_come_near_their_targets():
    """Documents of very different lengths: the words taken are within half of the shortest document, or 1 %."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        x = np.exp(rng.uniform(0.5, 8, int(rng.integers(30, 300)))).astype(int).astype(float)
        rate = rng.uniform(0.05, 0.95)
        before = np.full(len(x), rate)
        pi = mixing.exchange(mixing.land(mixing.flight(before, x, rng, mixing.LANDING), x), before, x)
        assert set(pi) <= {0.0, 1.0}
        assert abs((pi * x).sum() - rate * x.sum()) <= max(0.5 * x.min() + 1, 0.01 * rate * x.sum())


def test_many_rows_alike(spark, monkeypatch):
    """Equal rows are one entry, and their copies come back as rows, in tasks of bounded size."""
    monkeypatch.setattr(mixing, "_ROWS", 7000)
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("w w").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("words"))
    rest = spark.range(40_000).select((F.col("id") % 7).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 11).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, F.lit("b")).alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("words"))
    df = hot.unionByName(rest)
    out = mixing.mixed_rows(df)
    assert out.count() == 140_000
    got = out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 and r["over"] <= 0 for r in got)
    assert mixing.mix_documents(spark, df, "").count() == out.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("rows", [100_000, 7])
def test_sources_are_numbered_in_ranges(spark, rows):
    names = [f"host{i:03d}" for i in np.random.default_rng(1).permutation(60)] + [None, "Zürich", ""]
    per = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = mixing.numbered(per, rows)
    by_name = sorted(names, key=lambda n: (n is None, (n or "").encode()))
    assert {r["source"]: r["number"] for r in got.collect()} == {n: i for i, n in enumerate(by_name)}
    assert mixing.numbered(per.limit(0), rows).collect() == []

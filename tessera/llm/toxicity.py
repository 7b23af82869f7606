"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w . x): the weights w are shared by all
thresholds, and theta_1 < theta_2 < ... keeps the grades in order. The expected
severity is the sum of P(grade >= k).

Features of a text: its words and their beginnings of 4 and 6 letters, so that
forms of one stem share weight; a feature's value is log(1 + times). They are
hashed; the ``FEATURES`` that tell toxic labelled rows from others best are used.

The model is fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS`` at
most, those with the smallest hash of doc_id. Labels say toxic or not; a toxic
row's grade is 2 if its share of marked words (words far more frequent in toxic
rows) is at or above the median of toxic rows, otherwise 1.

Defined results: null and empty texts have no features and get the grade of the
intercepts; labels that are null or have no document are not used; several
labels of a document count as the largest, several documents under a labelled
id as one; without labels of both kinds every
document has severity 0 and none is rejected; repeated rows get equal grades.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, with_columns_from, written

SAMPLE_ROWS, FEATURES, HASH_BITS, GRADES = 12_000, 8192, 22, 3
RIDGE, STEPS, REJECT_AT, TRUST_Z2 = 5e-6, 400, 0.5, 25.0
_WORD = re.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << HASH_BITS) - 1
    names = [f"w{word}"] + [f"{n}{word[:n]}" for n in (4, 6) if len(word) >= n]
    return tuple(dict.fromkeys(zlib.crc32(x.encode()) & mask for x in names))


@dataclass
class Model:
    """Weights of hashed features and the ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def scorer(self):
        """A function from texts to the linear scores w . x."""
        memo: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(texts: list[str]) -> np.ndarray:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                times: Counter = Counter()
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    ids = memo.get(word)
                    if ids is None:
                        ids = tuple(f for f in features_of(word) if f in weights)
                        if len(memo) < 200_000:
                            memo[word] = ids
                    for f in ids:
                        times[f] += n
                out[i] = sum(weights[f] * np.log1p(n) for f, n in sorted(times.items()))
            return out

        return score

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one row for each."""
        theta = np.array(self.thresholds)[:, None]
        return 1 / (1 + np.exp(np.clip(theta - score, -500, 500)))


def fit(columns: list[int], row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> Model:
    """Fit on a sparse matrix: entries (row, col, value), whose columns are the hashed features ``columns``."""
    n, k = len(grade), grades - 1
    share = np.clip([(grade >= j).mean() for j in range(1, grades)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    w = np.zeros(len(columns))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    # Adam on the mean log-likelihood with a ridge; all of it deterministic
    moment, second = np.zeros(len(w) + k), np.zeros(len(w) + k)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    for step in range(1, STEPS + 1):
        theta = first + np.append(0, np.cumsum(np.exp(gaps)))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.bincount(row, value * w[col], n)
        hi, lo = sig(edges[grade + 1] - s), sig(edges[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad_w = np.bincount(col, value * (d_hi - d_lo)[row], len(w)) / n + RIDGE * w
        by_edge = [(-d_hi[grade == j].sum() + d_lo[grade == j + 1].sum()) / n for j in range(k)]
        grad = np.concatenate([grad_w, [sum(by_edge)], [np.exp(gaps[j]) * sum(by_edge[j + 1 :]) for j in range(k - 1)]])
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, first, gaps = w - move[: len(w)], first - move[len(w)], gaps - move[len(w) + 1 :]
    theta = first + np.append(0, np.cumsum(np.exp(gaps)))
    return Model({int(i): float(x) for i, x in zip(columns, w, strict=True)}, theta.tolist())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of ``docs``.

    Features are counted by Spark; the driver gets the chosen features and, of
    each sampled row, only these.
    """

    def featurise(batches):
        for batch in small_batches(batches, 1):
            ids, times, n = [], [], []
            for text in batch.column(1).to_pylist():
                words = Counter(_WORD.findall((text or "").lower()))
                own: Counter = Counter()
                for word, c in words.items():
                    for f in features_of(word):
                        own[f] += c
                ids.append(np.fromiter(own.keys(), np.int32, len(own)))
                times.append(np.fromiter(own.values(), np.int32, len(own)))
                n.append(sum(words.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(n, pa.int64()), batch.column(2)], ["doc_id", "ids", "times", "n", "toxic"])

    labelled = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("is_toxic"))
    sample = labelled.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample's size is bounded by its parameter; rows that share a labelled doc_id count once
    rows = texts.join(F.broadcast(sample), texts["doc_id"] == sample["labelled"]).select("doc_id", "text", F.least("is_toxic", F.lit(1)).alias("toxic")).dropDuplicates(["doc_id"])
    rows = written(rows.mapInArrow(featurise, "doc_id long, ids array<int>, times array<int>, n long, toxic int"), "toxic-sample")
    sick, well = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not sick or not well:
        return Model()
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    z = F.abs((F.log(a / F.lit(sick + 1)) - F.log(b / F.lit(well + 1))) / F.sqrt(1 / a + 1 / b))
    counts = rows.select(F.explode("ids").alias("f"), "toxic").groupBy("f").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b"))
    chosen = counts.where("a + b >= 3").orderBy(z.desc(), "f").limit(FEATURES).collect()
    columns = [r["f"] for r in chosen]
    place = {f: i for i, f in enumerate(columns)}

    def pick(batches):
        for batch in batches:
            ids, times = [], []
            for own, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = [(place[f], c) for f, c in zip(own, n, strict=True) if f in place]
                ids.append([k[0] for k in kept])
                times.append([k[1] for k in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), batch.column(3), batch.column(4)], ["doc_id", "ids", "times", "n", "toxic"])

    got = rows.mapInArrow(pick, rows.schema).toPandas().sort_values("doc_id", kind="stable")
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["ids"]])
    col, times = np.concatenate(got["ids"].tolist()).astype(np.int64), np.concatenate(got["times"].tolist()).astype(float)
    toxic = got["toxic"].to_numpy() > 0
    marked = np.array([r["a"] >= 5 and (r["a"] + 0.5) / (sick + 1) >= 20 * (r["b"] + 0.5) / (well + 1) for r in chosen], bool)
    share = np.bincount(row, times * marked[col], len(got)) / np.maximum(got["n"].to_numpy(), 1)
    grade = toxic.astype(np.int64) + (toxic & (share >= np.median(share[toxic])))
    # features that may tell rows apart by chance are shrunk more: the ridge acts on scaled values
    a, b = np.array([r["a"] for r in chosen]) + 0.5, np.array([r["b"] for r in chosen]) + 0.5
    z2 = (np.log(a / (sick + 1)) - np.log(b / (well + 1))) ** 2 / (1 / a + 1 / b)
    trust = z2 / (z2 + TRUST_Z2)
    model = fit(columns, row, col, np.log1p(times) * trust[col], grade)
    model.weights = {f: w * t for (f, w), t in zip(model.weights.items(), trust, strict=True)}
    return model


def severity(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """``docs`` with expected severity, probability of any toxicity and most likely grade; and these columns' names."""

    def make():
        score = model.scorer()

        def run(texts):
            above = model.above(score(texts)) if model.thresholds else np.zeros((1, len(texts)))
            each = -np.diff(np.vstack([np.ones(len(texts)), above, np.zeros(len(texts))]), axis=0)
            return [pa.array(above.sum(0)), pa.array(above[0]), pa.array(each.argmax(0).astype(np.int32))]

        return run

    return with_columns_from(docs, "text", make, [("expected_severity", "double"), ("p_toxic", "double"), ("grade", "int")])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` without those whose probability of toxicity is ``REJECT_AT`` or more."""
    out, (_, p, _) = severity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.where(F.col(p) < REJECT_AT).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole text of ``documents``: doc_id, expected_severity, p_toxic, grade, rejected."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, (s, p, g) = severity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col(s).alias("expected_severity"), F.col(p).alias("p_toxic"), F.col(g).alias("grade"), (F.col(p) >= REJECT_AT).alias("rejected"))

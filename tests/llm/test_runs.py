"""Runs of words against a count of all stretches and periods."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import runs

DOCS = "doc_id long, text string, start string, row string"


def brute_edges(s):
    n, out = len(s), []
    for i in range(n):
        out.append(next((j for j in range(i + 1, n) if s[j:] < s[i:]), n))
    return out


def brute_runs(s, min_length=6, periods=4):
    n, found = len(s), {}
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(min_length, periods * p):
                found.setdefault((i, length), p)  # the smallest period comes first
            i = j + 1
    return sorted(((i, n, p) for (i, n), p in found.items()), key=lambda r: (r[0], r[2]))


def strings():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 5):
        for _ in range(250):
            yield rng.integers(0, k, int(rng.integers(0, 40))).tolist()
    for _ in range(250):  # powers of short words, nested and cut
        root = rng.integers(0, 3, int(rng.integers(1, 6))).tolist()
        inner = root * int(rng.integers(1, 7)) + rng.integers(0, 3, int(rng.integers(0, 4))).tolist()
        yield rng.integers(0, 3, 3).tolist() + (inner * int(rng.integers(1, 6)))[: int(rng.integers(1, 150))] + root[:2]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_lyndon_edges_against_all_suffixes():
    for s in strings():
        nss, lce, _ = runs.lyndon_edges(s)
        assert nss == brute_edges(s), s
        for i, j in enumerate(nss):
            k = 0
            while j + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert lce[i] == k, (s, i)


@pytest.mark.parametrize("min_length, periods", [(6, 4), (2, 2), (5, 3)])
def test_runs_against_all_stretches(min_length, periods):
    for s in strings():
        assert runs.find_runs(s, min_length, periods) == brute_runs(s, min_length, periods), s


@pytest.mark.parametrize("s", [[0] * 30000, [0, 1] * 15000, fibonacci(30000), [0] * 15000 + [1] * 15000, ([0] * 99 + [1]) * 300, list(range(300)) * 100, [-c for c in fibonacci(30000)]])
def test_each_word_is_looked_at_once(s):
    work: list[int] = []
    runs.lyndon_edges(s, work=work)
    assert work[0] <= len(s)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts():
    rng = np.random.default_rng(8)
    some = [" ".join(rng.choice(list("abcé"), int(rng.integers(0, 60)))) for _ in range(150)]
    return [*some, None, "", " \t\n", "a", "x\x1fy\x85 z z " * 9, "la " * 200, "é\n" * 7 + "b", "a b\x0bc " * 20 + "a b", "dup dup", "dup dup", "go " * 8 + "and " + "a b " * 5 + "no " * 7]


def test_rows_against_brute_force(spark):
    rows = [(i, t, "s", "r") for i, t in enumerate(texts())] + [(None, "la " * 30, "s", "r"), (3, "la " * 30, None, None)]
    got = sorted(map(tuple, runs.run_digests(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str)
    assert got == sorted((brute_row(r[0], r[1]) for r in rows), key=str)
    assert any(r[1] > 1 for r in got)


def test_collapsed_texts_keep_the_other_columns(spark):
    df = spark.createDataFrame([(1, "no no no no no no yes", "s", "r"), (2, None, None, None)], DOCS)
    got = {r["row"]["doc_id"]: r for r in runs.collapse_runs(df).collect()}
    assert (got[1]["collapsed"], got[1]["row"]["start"], [tuple(x) for x in got[1]["runs"]]) == ("no yes", "s", [(0, 6, 1)])
    assert (got[2]["collapsed"], got[2]["runs"]) == ("", [])


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert runs.run_digests(empty).count() == 0 and runs.collapse_runs(empty).count() == 0


def test_a_very_long_text():
    words = ["tick", "tock"] * 100_000 + ["end"]
    assert runs.runs_in_words(words) == [(0, 200_000, 2)]


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    long = {i for i, t in docs.items() if len((t or "").split()) > 800}  # the count of all stretches is slow
    got = [tuple(r) for r in runs.op12_runs(spark, folder).collect()]
    assert len(got) == len(docs)
    assert [r for r in got if r[0] not in long and r != brute_row(r[0], docs[r[0]])] == []

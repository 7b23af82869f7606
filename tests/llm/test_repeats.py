"""Removal of repeated strings against a brute-force count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats

DOCS = "doc_id long, text string, key string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, alphabet="abcdefgh é"):
    word = lambda n: "".join(rng.choice(list(alphabet), n))
    shared = [word(int(n)) for n in (30, 39, 40, 41, 60, 200)]
    texts = [word(int(rng.integers(0, 150))) for _ in range(20)]
    for _ in range(60):
        parts = [word(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(0, len(shared)))], word(int(rng.integers(0, 30)))]
        texts.append("".join(parts))
    long = word(600)
    for _ in range(30):  # near copies: one letter changed
        i = int(rng.integers(0, len(long)))
        texts.append(long[:i] + "X" + long[i + 1 :])
    texts += ["ab" * 100, "a" * 90, "a" * 41, "a" * 40, None, "", long, long]
    return texts


@pytest.mark.parametrize("hot, alphabet", [(2000, "abcdefgh é"), (3, "abcdefgh é"), (3, "ab")])
def test_against_brute_force(spark, hot, alphabet):
    texts = corpus(np.random.default_rng(11), alphabet)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(df, length=40, seed=13, hot=hot).collect()}
    want = brute(texts, 40)
    assert {i: w for i, w in enumerate(want) if got[i] != w} == {}


@pytest.mark.parametrize("hot", [2000, 3])
def test_later_loads_meet_the_kept_levels(spark, hot, tmp_path, monkeypatch):
    """Each load's rows are judged over all loads so far; the index goes through files in between."""
    monkeypatch.setattr(repeats, "SHARD_SPANS", 40)
    monkeypatch.setattr(repeats, "BATCH_SPANS", 16)
    texts = corpus(np.random.default_rng(5))
    order = np.random.default_rng(6).permutation(len(texts)).tolist()
    loads, index = [order[:50], order[50:90], [], order[90:]], None
    for k, load in enumerate(loads):
        df = spark.createDataFrame([(i, texts[i], "z") for i in load], DOCS).repartition(2)
        done, index = repeats.add_load(df, index, length=40, seed=13, hot=hot)
        so_far = [i for part in loads[: k + 1] for i in part]
        want = dict(zip(so_far, brute([texts[i] for i in so_far], 40), strict=True))
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in done.collect()}
        assert got == {i: want[i] for i in load}
        index.save(str(tmp_path / f"index-{k}"))
        index = repeats.RepeatIndex.load(spark, str(tmp_path / f"index-{k}"))
    ranks = index.levels.groupBy("shard", "rank").count().collect()
    assert max(r["rank"] for r in ranks) > 0 or hot == 3


def test_batches_meet_in_the_index_family(monkeypatch):
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 300, dtype=np.uint8))
    texts = [base[:i] + b"#" + base[i + 1 :] for i in rng.integers(0, 300, 40)]
    family = repeats.IndexFamily(40)
    rows = [(t, o, lo, n, left) for t, (o, lo, n, left) in [(texts[o], (o, lo, n, left)) for o, lo, n, left, _, _ in zip(*repeats.spans_of(texts, 40, 13), strict=True)]]
    for at in range(0, len(rows), 7):
        part = rows[at : at + 7]
        cutout = [t[lo : lo + n + 39] for t, _, lo, n, _ in part]
        family.add(repeats.Level([c[r[4] :] for c, r in zip(cutout, part, strict=True)], [c[: r[4]][::-1] for c, r in zip(cutout, part, strict=True)], np.array([r[3] for r in part]), np.ones(len(part), np.int64), np.arange(at, at + len(part))))
    assert len(family.levels) == bin(-(-len(rows) // 7)).count("1")
    got = {(rows[i][1], rows[i][2] + o) for ids, off in family.found for i, o in zip(ids.tolist(), off.tolist(), strict=True)}
    count = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 39) if count[t[i : i + 40]] > 1}


def test_repeated_rows_and_clashing_columns(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, "short", None), (None, None, None)], "doc_id long, text string, row string")
    rows = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.without_repeats(df).collect()), key=str)
    n = len(text)
    assert rows == [(1, n, n, 1), (1, n, n, 1), (None, 0, 0, 0), (None, 5, 0, 0)]
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_a_later_load_reads_and_writes_what_it_meets(spark, tmp_path, monkeypatch):
    """Ten loads of equal size: the last writes no more than a few times what the first wrote, and the index grows by appending."""
    sizes = []

    def spy(df, label, *rest, real=repeats.written):
        out = real(df, label, *rest)
        if label in ("repeat-levels", "repeat-met-levels"):
            sizes[-1] += out.count()
        return out

    monkeypatch.setattr(repeats, "written", spy)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, texts, index, path = word(120), [], None, str(tmp_path / "index")
    for k in range(10):
        some = [word(200) for _ in range(12)]
        some += [word(40) + some[int(rng.integers(0, 12))][50:150] + word(30) for _ in range(6)] + [word(20) + shared + word(20)]
        rows = [(k * 100 + i, t, "k") for i, t in enumerate(some)]
        texts += some
        sizes.append(0)
        got, index = repeats.add_load(spark.createDataFrame(rows, DOCS), index, length=40, seed=13)
        want = brute(texts, 40)[-len(some) :]
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == sorted(want)
        index.save(path, all_loads=not k)
        index = repeats.RepeatIndex.load(spark, path)
    assert 0 < sizes[9] <= 4 * max(sizes[:2]), sizes


def brute_passages(texts, words):
    data = [(t or "").encode().split() for t in texts]
    holders = {}
    for i, d in enumerate(data):
        for k in range(len(d) - words + 1):
            holders.setdefault(tuple(d[k : k + words]), set()).add(i)
    return [len({j for k in range(len(d) - words + 1) if len(holders[tuple(d[k : k + words])]) > 1 for j in range(k, k + words)}) for d in data]


def test_passages_too_short_in_bytes_are_counted(spark):
    """51 words of 300 bytes lose nothing by the 400-byte rule, 50 words are no passage, and white space does not matter."""
    word = lambda k, i: f"{k}w{i:02d}"
    run = lambda k, n: " ".join(word(k, i) for i in range(n))
    texts = [run("p", 51), f"x {run('p', 51)} y", run("q", 50), f"{run('q', 50)} z", run("r", 60), run("r", 60).replace(" ", "\n \t"), f"{run('s', 51)} {run('s', 51)}", None, ""]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["n_passage_words"]) for r in repeats.without_repeats(df, passages=repeats.PASSAGE).collect()}
    assert got == dict(enumerate([(0, 51), (0, 51), (0, 0), (0, 0), (0, 60), (0, 60), (0, 0), (0, 0), (0, 0)]))


@pytest.mark.parametrize("piece, hot", [(4 << 20, 2000), (90, 3)])
def test_passages_against_brute_force(spark, piece, hot, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", piece)
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(rng.choice(list("abcdefghé"), n))
    texts = corpus(rng) + [" ".join("ab" * 60), "a " * 70, "\u2003".join("abcdefghijklmnopq")]
    shared = [some(int(n)) for n in (9, 10, 11, 30)]
    texts += [" ".join(x for _ in range(3) for x in (some(int(rng.integers(1, 20))), shared[int(rng.integers(0, 4))])) for _ in range(40)]
    long = some(150).split()
    for _ in range(20):  # near copies: one word changed
        i = int(rng.integers(0, 150))
        texts.append(" ".join([*long[:i], "XYZ", *long[i + 1 :]]))
    loads, index = [range(0, len(texts), 2), range(1, len(texts), 2)], None
    for k, load in enumerate(loads):
        df = spark.createDataFrame([(i, texts[i], "z") for i in load], DOCS).repartition(3)
        done, index = repeats.add_load(df, index, length=40, seed=13, hot=hot, passages=10)
        so_far = [i for part in loads[: k + 1] for i in part]
        want = dict(zip(so_far, brute_passages([texts[i] for i in so_far], 10), strict=True))
        assert {r["doc_id"]: r["n_passage_words"] for r in done.collect()} == {i: want[i] for i in load}

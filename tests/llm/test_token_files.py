"""Token ids: exact round trips of blocks, and ids equal to the tokenizer's own."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 4096])
@pytest.mark.parametrize("kind", ["small", "outliers", "equal", "wide"])
def test_blocks(n, kind):
    rng = np.random.default_rng(n)
    ids = {"small": rng.integers(0, 50000, n), "outliers": np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(100, 200, n)), "equal": np.full(n, 7), "wide": rng.integers(0, 2**32, n)}[kind].astype(np.uint32)
    shard = tf.pack_blocks(ids)
    assert (tf.ids_between(shard) == ids).all()
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, n), (n, n + 5), (5, 3)):
        assert (tf.ids_between(shard, a, b) == ids[a:b]).all()
    if kind == "outliers" and n > 1000:
        assert len(shard) < 2 * n


def test_ids_are_the_tokenizers_own(tokenizer):
    rng = random.Random(1)
    alphabet = [*"ab'sélt  \n\t\r1 2.,!\xa0 \x1c\x85ß中🙂", "<|endoftext|>", " <|endoftext|>", "'ll", "  ", "\n\n", " \n", "\nthe", " word", "Straße", "ǅé,", " ĳǀȳ.", "ªº"]
    encoder = tf.WordEncoder(public_tokenizers.path(tf.TOKENIZER))
    for _ in range(20):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(200)]
        for text, ids in zip(texts, encoder.batch(texts)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark, tokenizer):
    rows = [(5, "five  spaces \n\n here"), (3, None), (3, ""), (9, "x " * 40000), (-2, "minus"), (None, "none"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.token_digests(df).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.token_digests(df.limit(0)).collect() == []


def test_shards_split_between_documents(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(100)], "doc_id long, text string")
    shards = tf.encode_tables(df, shard_ids=16)
    rows = tf.read_documents(tf.written(shards, "test")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(100))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert shards.count() > 10


def test_order_does_not_depend_on_the_splits(spark):
    rows = [(i % 3 if i % 4 else None, f"text {i % 7}", "x") for i in range(200)]
    got = []
    for parts, order in ((1, 1), (7, -1)):
        df = spark.createDataFrame(rows[::order], "doc_id long, text string, other string").repartition(parts)
        back = tf.read_documents(tf.written(tf.encode_tables(df, task_bytes=300), "test"))
        got.append(sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in back.collect()))
    assert got[0] == got[1] and [r[1] for r in got[0]] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))


def test_tasks_follow_the_bytes(spark):
    df = spark.createDataFrame([(i, "word " * 50) for i in range(400)], "doc_id long, text string")
    parts = tf.written(tf.encode_tables(df, task_bytes=5000), "test").select("part").distinct().count()
    assert 15 <= parts <= 20


def other_tokenizers(tmp_path):
    """Byte-level BPE without the splitting pattern, one that puts a space before the text, and one that lower-cases."""
    import json

    said = json.load(open(public_tokenizers.path(tf.TOKENIZER)))
    for name, changes in (("whole", {"use_regex": False}), ("prefix", {"add_prefix_space": True}), ("lower", None)):
        own = json.loads(json.dumps(said))
        if changes is None:
            own["normalizer"] = {"type": "Lowercase"}
        else:
            own["pre_tokenizer"] |= changes
        if name == "whole":  # merges over spaces
            own["model"]["merges"] = [["a", "Ġ"], *own["model"]["merges"]]
            own["model"]["vocab"]["aĠ"] = len(own["model"]["vocab"])
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(own))
        yield str(path)
    yield public_tokenizers.path("word_bpe_49k.json")


def test_other_tokenizers_give_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["a b a  c", "Hello World\n\nA a", "", " a ", "été a É", "x\ny"]
    assert tf.cuts_at_spaces(public_tokenizers.path(tf.TOKENIZER))
    for path in other_tokenizers(tmp_path):
        own = Tokenizer.from_file(path)
        want = [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert not tf.cuts_at_spaces(path)
        assert [x.tolist() for x in tf.WordEncoder(path).batch(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tf.read_documents(tf.written(tf.encode_tables(df, path), "test")).collect()}
    assert got == {i: len(w) + 1 for i, w in enumerate(want)}

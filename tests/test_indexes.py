"""Stored indexes against recounts and scans, and what their plans read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import acl, text, vectors
from tessera.operators import retrieval
from tessera.operators.postings import Literals, Postings, trigrams_of
from tessera.operators.vector_index import VectorIndex, recall
from tessera.sources.generations import Generations

CHUNKS = "id long, content string"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- partitions that change together


def table(spark, path):
    return Generations(spark, str(path), "k string, v long")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v long, part int")


def test_loads_replace_and_add(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and t.read().collect() == [] and t.read([1]).columns == ["k", "v", "part"]
    assert t.commit([t.stage(rows(spark, ("a", 1, 0), ("b", 2, 1)))]) == 1
    t.commit([t.stage(rows(spark, ("c", 3, 0)))])
    assert rows_of(t.read()) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 0)]
    t.commit([t.stage(rows(spark, ("d", 4, 0))), t.stage(rows(spark, ("e", 5, 0)))], [0, 1])
    assert rows_of(t.read()) == [("d", 4, 0), ("e", 5, 0)] and rows_of(t.read([1])) == []
    t.commit([t.stage(rows(spark, ("f", 6, 1)))])
    assert rows_of(t.read([1])) == [("f", 6, 1)]
    assert rows_of(t.read(version=2)) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 0)]  # older versions stay


def test_a_load_that_dies_before_the_switch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit([t.stage(rows(spark, ("a", 1, 0)))])
    t.stage(rows(spark, ("lost", 2, 0)))
    assert rows_of(t.read()) == [("a", 1, 0)] == rows_of(table(spark, tmp_path).read())
    with pytest.raises(Exception, match="never"):
        t.stage(rows(spark, ("lost", 3, 0)).withColumn("v", F.raise_error(F.lit("never")).cast("long")))
    t.commit([t.stage(rows(spark, ("b", 4, 1)))])
    assert rows_of(t.read()) == [("a", 1, 0), ("b", 4, 1)]


def test_other_partitions_are_not_opened(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit([t.stage(rows(spark, *[("x", i, i % 8) for i in range(80)]))])
    found = t.read([3])
    assert len(found.inputFiles()) == 8
    files = found.select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "part=3" in files[0][0]


# --- words


WORDS = ["oak", "pine", "shelf", "the", "a", "red", "blue", "één", "x9"]


def random_texts(rng, ids):
    return {i: None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 7))) for i in ids}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), CHUNKS)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_the_counts_of_a_recount(spark, tmp_path, seed):
    rng = random.Random(seed)
    index, now = Postings(spark, str(tmp_path), buckets=4), {}
    for step in range(5):
        touched = rng.sample(range(40), 15)
        after = random_texts(rng, [i for i in touched if rng.random() < 0.7])
        before = {i: now[i] for i in touched if i in now}
        index.update(frame(spark, before) if before else None, frame(spark, after) if after else None)
        now = {i: t for i, t in now.items() if i not in touched} | after
        if step == 3:
            index.fold()
        want = frame(spark, now)
        assert rows_of(index.frequencies()) == rows_of(text.document_frequency(want)), step
        assert index.total() == len(now)
        held = {(w, i) for i, t in now.items() for w in text.analyse(t or "")}
        assert set(rows_of(index.all_postings())) == held
        assert set(rows_of(index.postings(["the", "één", "none"]))) == {(w, i) for w, i in held if w in ("the", "één")}


def test_search_by_postings_equals_the_search_by_scan(spark, tmp_path):
    rng = random.Random(3)
    c = spark.createDataFrame([(i, f"s{i % 3}", f"d{i % 5}", i % 4, t) for i, t in random_texts(rng, range(200)).items()], "id long, source_id string, document string, page int, content string")
    c = c.withColumn("embedding", F.array(F.col("id").cast("float"), F.lit(7.0).cast("float")))
    s = spark.createDataFrame([("s0", ["all"], ["n"], "active"), ("s1", ["other"], ["n"], "active"), ("s2", ["all"], ["n"], "active")], "id string, acl_groups array<string>, companies array<string>, state string")
    who = acl.Principal.of(["all", "company-n"])
    index = Postings(spark, str(tmp_path))
    index.update(None, c)
    counts, total = text.document_frequency(c), c.count()
    for q in ("red oak", "the", "één unknown", "", "blue x9 the the"):
        for divisor in (1, 2, 4, 1000):
            for fallback in (False, True):
                want = retrieval.lexical_branch(c, counts, total, q, 9, divisor, fallback).select("id", "score", "rank")
                assert rows_of(index.best(q, 9, divisor, c, fallback)) == rows_of(want), (q, divisor, fallback)
    for options in ({}, {"pattern": "red"}, {"pattern": "nothing"}, {"documents": ["d1", "d2"]}):
        for vector in ([5.0, 1.0], None):
            got, g = retrieval.indexed_search(c, s, index, who, "red shelf", vector, divisor=3, **options)
            want, w = retrieval.hybrid_search(c, s, counts, total, who, "red shelf", vector, divisor=3, **options)
            assert g == w and rows_of(got.select("id", "points")) == rows_of(want.select("id", "points"))


def test_a_search_opens_the_partitions_of_its_words(spark, tmp_path):
    index = Postings(spark, str(tmp_path), buckets=32)
    index.update(None, spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(500)], CHUNKS))
    found = index.postings(["w7", "common"])
    assert re.search(r"PushedFilters: \[.*In\(word, \[common,w7\]\)", plan_of(found))
    opened = index.table.read({index._bucket(w) for w in ("w7", "common")}).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"part=(\d+)", r["f"]).group(1) for r in opened}) <= 2


# --- literal strings


def test_literal_search_equals_the_scan_for_any_term(spark, tmp_path):
    rng = random.Random(5)
    alphabet = "abAB é%_\\.\nß😀"
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for i in range(150)} | {900: None, 901: "", 902: "ab" * 3000, 903: "ab" * 3000}
    c = frame(spark, texts)
    index = Literals(spark, str(tmp_path), buckets=4, rarest=2)
    index.update(None, c)
    some = [t for t in texts.values() if t]
    terms = ["", "a", "AB", "zzz", "a%b", "abABzz", "😀", "é%_\\"]
    for _ in range(25):
        t = rng.choice(some)
        at = rng.randrange(len(t))
        terms.append(t[at : at + rng.randrange(1, 9)])
    terms += ["".join(rng.choice(alphabet) for _ in range(4)) for _ in range(10)]
    for term in terms:
        want = rows_of(c.where(text.contains(F.col("content"), term)).select("id"))
        assert rows_of(index.containing(c, term).select("id")) == want, term


def test_literal_search_reads_groups_of_the_term_only(spark, tmp_path):
    c = spark.createDataFrame([(i, f"item {i} of the catalogue") for i in range(300)], CHUNKS)
    index = Literals(spark, str(tmp_path), buckets=32)
    index.update(None, c)
    plan = plan_of(index.containing(c, "item 29"))
    named = re.findall(r"In\(word, \[([^\]]*)\]\)", plan)
    assert named and set(named[0].split(",")) <= set(trigrams_of("item 29")) and len(named[0].split(",")) <= 4


def test_changed_texts_are_found_by_their_new_strings(spark, tmp_path):
    index = Literals(spark, str(tmp_path), buckets=4)
    old, new = frame(spark, {1: "first draft", 2: "stays"}), frame(spark, {1: "final text"})
    index.update(None, old)
    index.update(old.where("id = 1"), new)
    now = new.unionByName(old.where("id = 2"))
    assert rows_of(index.containing(now, "draft").select("id")) == [] and rows_of(index.containing(now, "Final").select("id")) == [(1,)]


# --- vectors in cells


def clustered(spark, n=6000, dim=16, groups=60):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(groups, dim))
    data = centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, f"s{i % 4}", [float(x) for x in v]) for i, v in enumerate(data)], "id long, source_id string, embedding array<float>")


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    data = clustered(spark)
    path = str(tmp_path_factory.mktemp("cells") / "index")
    index = VectorIndex(spark, path)
    index.train(data, 64)
    index.add(data.unionByName(spark.createDataFrame([(9000, "s0", None), (9001, "s0", [0.0] * 16)], data.schema)))
    return data, index


def test_all_cells_give_the_scan(cells):
    data, index = cells
    query = data.where("id = 17").first()["embedding"]
    assert index.table.read().count() == 6000
    want = rows_of(vectors.nearest(data, query, 25).select("id", "distance", "rank"))
    assert rows_of(index.search(query, 25, 1000).select("id", "distance", "rank")) == want


def test_recall_of_eight_cells_in_sixty_four(cells):
    data, index = cells
    asked = data.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding")
    exact = index.search_many(asked, 10, 64)
    assert rows_of(exact.where("query = 300").select("id", "rank")) == rows_of(vectors.nearest(data, data.where("id = 300").first()["embedding"], 10).select("id", "rank"))
    assert recall(index.search_many(asked, 10, 8), exact) >= 0.9


def test_a_probe_opens_its_cells_and_filters_access_below_the_ranks(spark, cells):
    data, index = cells
    s = spark.createDataFrame([("s0", ["all"], ["n"], "active"), ("s1", ["x"], ["n"], "active")], "id string, acl_groups array<string>, companies array<string>, state string")
    query = data.where("id = 17").first()["embedding"]
    found = index.search(query, 10, 4, s, acl.Principal.of(["all", "company-n"]))
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\n]*part#\d+ IN \(\d+,\d+,\d+,\d+\)", plan)
    got = found.collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11)) and {r["source_id"] for r in got} == {"s0"}
    plain = [line for line in plan.split("Physical Plan ==")[-1].splitlines() if "TakeOrdered" in line or "SemiJoin" in line or "LeftSemi" in line]
    assert "TakeOrdered" in plain[0]  # the join lies below


def test_replaced_vectors(spark, tmp_path):
    data = clustered(spark, n=400, groups=8)
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.train(data, 8, sample=40)
    index.add(data)
    before = index.table.loads()
    moved = spark.createDataFrame([(5, "new", [1.0] * 16), (7000, "new", [-1.0] * 16)], data.schema)
    index.replace(spark.createDataFrame([(5,), (6,), (123456,)], "id long"), moved)
    now = data.where("id not in (5, 6)").unionByName(moved)
    assert rows_of(index.table.read().select("id", "source_id")) == rows_of(now.select("id", "source_id"))
    assert rows_of(index.search([1.0] * 16, 15, 8).select("id")) == rows_of(vectors.nearest(now, [1.0] * 16, 15).select("id"))
    assert set(index.table.loads()) & set(before)  # cells without a changed row are still those of the first load


def test_blocks_hold_a_word_once_and_fold_shares_hot_words(spark, tmp_path, monkeypatch):
    index = Postings(spark, str(tmp_path), buckets=4)
    first = spark.createDataFrame([(i, f"the w{i}") for i in range(500)] + [(None, "the null")], CHUNKS).coalesce(1)
    index.update(None, first)
    blocks = index.table.read(range(4))
    assert blocks.where("word = 'the'").count() == 1 and blocks.agg(F.sum("n")).first()[0] == 1002
    index.update(first.where("id < 400"), None)
    want = {("the", i) for i in range(400, 500)} | {(f"w{i}", i) for i in range(400, 500)} | {("the", None), ("null", None)}
    assert set(map(tuple, index.all_postings().collect())) == want
    assert set(map(tuple, index.all_postings(spark.createDataFrame([("w450",), ("w3",)], "word string")).collect())) == {("w450", 450)}
    monkeypatch.setattr("tessera.operators.postings.HOT", 300)
    index.fold()
    assert set(map(tuple, index.all_postings().collect())) == want and index.total() == 101
    assert index.table.read(range(4)).where("n < 0").isEmpty() and index.frequencies(["the"]).first()["n_chunks"] == 101


def test_tasks_that_write_a_part_join_blocks_and_sum_them(spark, tmp_path, monkeypatch):
    trees = lambda k: spark.createDataFrame([(i, f"the {('oak', 'pine')[(i + k) % 2]}") for i in range(90)], CHUNKS).repartition(5)
    index = Postings(spark, str(tmp_path / "a"), buckets=2)
    index.update(None, trees(0))
    index.update(trees(0), trees(1))
    blocks = index.table.read(range(2))
    assert rows_of(blocks.groupBy("word").agg(F.count("n"), F.sum("n"))) == [("oak", 3, 45), ("pine", 3, 45), ("the", 1, 90)]
    assert rows_of(index.table.read([2, 3]).select("word", "n")) == [("oak", 45), ("pine", 45), ("the", 90)]  # gains and losses are even
    assert rows_of(index.all_postings()) == sorted([("the", i) for i in range(90)] + [(("oak", "pine")[(i + 1) % 2], i) for i in range(90)])
    monkeypatch.setattr("tessera.operators.postings.BLOCK", 30)
    index = Postings(spark, str(tmp_path / "b"), buckets=2)
    index.update(None, trees(0))
    sizes = [r["n"] for r in index.table.read(range(2)).where("word = 'the'").collect()]
    assert sum(sizes) == 90 and len(sizes) > 1 and rows_of(index.frequencies()) == [("oak", 45), ("pine", 45), ("the", 90)]


def test_rounds_of_the_queries_make_five_loads(spark, tmp_path, monkeypatch):
    from tessera.plans import indexes

    texts = {i: f"the clown w{i} w{i % 7}" for i in range(60)} | {60: None, None: "the nameless"}
    docs = [(i, t, "en", "src0" if i and i % 5 == 1 else None if i == 3 else "src2") for i, t in texts.items()]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    held = {(w, i) for i, t, _, s in docs if s != "src0" for w in text.analyse(t or "")}
    want = {}
    for w, _ in held:
        want[w] = want.get(w, 0) + 1
    index = indexes._rounds(spark, folder)
    assert index.table.version() == 5 and index.total() == sum(s != "src0" for *_, s in docs)
    blocks = index.table.read(range(index.buckets))
    assert blocks.where("n < 0").isEmpty() and blocks.agg(F.sum("n")).first()[0] == len(held)
    before = index.table.read(range(index.buckets, 2 * index.buckets), version=4)
    assert not before.where("n < 0").isEmpty() and before.where("word = 'draft'").agg(F.count("n"), F.sum("n")).first() == (2, 0)
    assert dict(rows_of(index.frequencies(version=4))) == want == dict(rows_of(index.frequencies()))
    monkeypatch.setattr(indexes, "_rounds", lambda *_: index)
    assert rows_of(indexes.postings_rounds(spark, folder)) == sorted(want.items())
    found = indexes.postings_folded(spark, folder).collect()
    assert {(r["word"], r["id"]) for r in found} == {(w, i) for w, i in held if w in ("clown", "the")} and {r["total"] for r in found} == {index.total()}


def test_blocks_of_queries_and_vectors(spark, tmp_path, monkeypatch):
    """No task holds a cell's pairs: many small blocks give the ranks of the scan, copies by the smallest ids."""
    monkeypatch.setattr("tessera.operators.vector_index.QUERIES_AT_ONCE", 3)
    monkeypatch.setattr("tessera.operators.vector_index.VECTORS_AT_ONCE", 40)
    data = clustered(spark, n=600, groups=8)
    data = data.unionByName(data.where("id < 30").select((F.col("id") + 5000).alias("id"), "source_id", "embedding")).unionByName(data.where("id = 7").crossJoin(spark.range(8000, 8025).toDF("k")).select(F.col("k").alias("id"), "source_id", "embedding"))
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.train(data, 4, sample=40)
    index.add(data)
    asked = data.where("id % 100 = 7").select(F.col("id").alias("query"), "embedding")
    found = index.search_many(asked, 12, 4)
    assert "FlatMapCoGroupsInArrow" in plan_of(found)
    for q in (7, 107, 307):
        want = vectors.nearest(data, data.where(f"id = {q}").first()["embedding"], 12).select("id", "distance", "rank")
        assert rows_of(found.where(f"query = {q}").select("id", "distance", "rank")) == rows_of(want), q

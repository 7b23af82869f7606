"""As-of joins with hot keys, and histories that are stored."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import history

T = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
FACTS = "id long, k string, at timestamp_ntz, valid_to string"
VERSIONS = "k string, v long, valid_from timestamp_ntz, valid_to timestamp_ntz"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_case(rng):
    versions, n = [], 0
    for k in "abc":
        day = rng.randrange(0, 40)
        for _ in range(rng.randrange(0, 9)):
            end = day + rng.randrange(0, 60)
            versions.append((k, n, T(day), None if rng.random() < 0.1 else T(end)))
            n += 1
            if versions[-1][3] is None:
                break
            day = end + rng.choice([0, 0, 5])
    facts = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *[T(x) for x in range(0, 300, 3)]]), "x") for i in range(120)]
    return facts, versions


@pytest.mark.parametrize("seed", range(4))
def test_as_of_join_against_all_pairs(spark, seed):
    facts, versions = random_case(random.Random(seed))
    f = spark.createDataFrame(facts, FACTS).withColumnRenamed("valid_to", "note")
    v = spark.createDataFrame(versions, VERSIONS)
    want = []
    for i, k, at, note in facts:
        hits = [x for x in versions if x[0] == k and at is not None and x[2] <= at and (x[3] is None or at < x[3])]
        assert len(hits) < 2
        want += [(i, k, at, note, *(hits[0][1:] if hits else (None, None, None)))]
    for hot in (10**9, 20, 0):
        assert as_rows(history.as_of_join(f, v, "k", "at", hot=hot)) == sorted(want, key=repr)
        inner = [w for w in want if w[4] is not None]
        assert as_rows(history.as_of_join(f, v, "k", "at", "inner", hot=hot)) == sorted(inner, key=repr)


def test_a_hot_key_of_a_million_facts(spark):
    """Ten thousand versions of one key: facts are cut by period, and none meets more than one version."""
    f = spark.range(1_000_000).select(F.col("id"), F.lit("hot").alias("k"), (F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 100)).cast("timestamp_ntz").alias("at"))
    f = f.unionByName(spark.range(1000).select((F.col("id") + 5_000_000).alias("id"), F.col("id").cast("string").alias("k"), F.lit("2020-06-01").cast("timestamp_ntz").alias("at")))
    v = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"), F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 10_000).cast("timestamp_ntz").alias("valid_from"), F.timestamp_seconds(F.lit(1_577_836_800) + (F.col("id") + 1) * 10_000).cast("timestamp_ntz").alias("valid_to"))
    got = history.as_of_join(f, v, "k", "at").withColumn("task", F.spark_partition_id())
    row = got.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("k") == "hot") & (F.floor(F.col("id") / 100) == F.col("v"))).alias("right"), F.countDistinct(F.when(F.col("k") == "hot", F.col("task"))).alias("tasks")).first()
    assert (row["n"], row["right"]) == (1_001_000, 1_000_000) and row["tasks"] > 1


ROWS = "id string, company string, name string, ref string, seq int"


def loads(rng, n):
    ids = [str(i) for i in range(30)]
    for step in range(n):
        some = rng.sample(ids, rng.randrange(18, 30))
        yield [(i, "acme", rng.choice(["x", "y", None]), rng.choice(["1", None]), s) for i in some for s in range(rng.randrange(1, 3))], step % 2 == 0, T(step)


def test_stored_history_equals_the_merge_in_memory(spark, tmp_path):
    rng = random.Random(4)
    kept, memory = history.StoredHistory(spark, str(tmp_path / "h"), "name string, ref string", 4), None
    memory = kept.versions()
    for rows, full, moment in loads(rng, 5):
        incoming, now = spark.createDataFrame(rows, ROWS), F.lit(moment).cast("timestamp_ntz")
        assert kept.load(incoming, ["ref"], "seq", now, full) == "ok"
        memory, said = history.load(memory, incoming, ["ref"], "seq", now, full)
        assert said == "ok"
        memory = spark.createDataFrame(memory.collect(), memory.schema)
        assert as_rows(kept.versions()) == as_rows(memory)
        assert as_rows(kept.current()) == as_rows(history.current(memory))
        assert history.broken_intervals(kept.versions()).collect() == []
    again = kept.table.version(), kept.versions().count()
    assert kept.load(incoming, ["ref"], "seq", F.lit(T(9)).cast("timestamp_ntz"), False) == "ok"
    assert (kept.table.version(), kept.versions().count()) == (again[0] + 1, again[1])  # a replay adds no version
    assert as_rows(kept.of_ids(["acme:3", "acme:4"])) == as_rows(memory.where("id in ('acme:3', 'acme:4')"))


def test_an_incremental_load_rewrites_its_buckets_only(spark, tmp_path):
    kept = history.StoredHistory(spark, str(tmp_path / "h"), "name string, ref string", 8)
    now = lambda n: F.lit(T(n)).cast("timestamp_ntz")
    kept.load(spark.createDataFrame([(str(i), "acme", "x", None, 1) for i in range(64)], ROWS), ["ref"], "seq", now(0), True)
    first = next(iter(kept.table.loads()))
    kept.load(spark.createDataFrame([("5", "acme", "changed", None, 1)], ROWS), ["ref"], "seq", now(1), False)
    held = kept.table.loads()
    assert len(held[first]) == 7 and {len(p) for load, p in held.items() if load != first} == {2}  # its open bucket, and its closed one
    assert kept.current().count() == 64 and kept.versions().count() == 65
    assert all("part=" in f and int(f.split("part=")[1].split("/")[0]) < 8 for f in [r[0] for r in kept.current().select(F.input_file_name()).distinct().collect()])


def test_a_load_killed_between_stage_and_switch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    kept = history.StoredHistory(spark, path, "name string, ref string", 4)
    now = lambda n: F.lit(T(n)).cast("timestamp_ntz")
    kept.load(spark.createDataFrame([("1", "acme", "x", None, 1), ("2", "acme", "y", None, 1)], ROWS), ["ref"], "seq", now(0), True)
    before = as_rows(kept.versions())

    def killed(*_):
        raise KeyboardInterrupt

    incoming = spark.createDataFrame([("1", "acme", "z", None, 1), ("2", "acme", "y", None, 1)], ROWS)
    with monkeypatch.context() as m:
        m.setattr(history.StoredHistory, "switch", killed)
        with pytest.raises(KeyboardInterrupt):
            kept.load(incoming, ["ref"], "seq", now(1), True)
    assert as_rows(history.StoredHistory(spark, path, "name string, ref string", 4).versions()) == before
    assert kept.load(incoming, ["ref"], "seq", now(1), True) == "ok"
    assert [(r["name"], r["valid_to"]) for r in kept.of_ids(["acme:1"]).orderBy("valid_from").collect()] == [("x", T(1)), ("z", None)]


def test_a_collapsed_load_changes_nothing(spark, tmp_path):
    kept = history.StoredHistory(spark, str(tmp_path / "h"), "name string, ref string", 4)
    kept.load(spark.createDataFrame([(str(i), "acme", "x", None, 1) for i in range(10)], ROWS), ["ref"], "seq", F.lit(T(0)).cast("timestamp_ntz"), True)
    before, version = as_rows(kept.versions()), kept.table.version()
    said = kept.load(spark.createDataFrame([("1", "acme", "x", None, 1)], ROWS), ["ref"], "seq", F.lit(T(1)).cast("timestamp_ntz"), True)
    assert said.startswith("collapsed by 90") and (as_rows(kept.versions()), kept.table.version()) == (before, version)

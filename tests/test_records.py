"""Joins, rounds, messages and exports on fixed cases with nulls, ties and empties."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import business, history, ingest, reports, retrieval
from tessera.sources import files


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_subjects_roles_and_addresses(spark):
    s = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False), (None, "d", False)], "id long, name string, obsolete boolean")
    r = spark.createDataFrame([(1, "C", False, "x"), (1, "C", False, "y"), (1, "F", False, "z"), (2, "C", False, "x"), (3, "C", True, "x"), (None, "C", False, "x")], "id long, kind string, obsolete boolean, pay string")
    assert rows_of(business.with_role(s, r, "id", "C", ["pay"])) == [(1, "a", "x"), (1, "a", "y")]
    a = spark.createDataFrame([(9, 1, False), (8, 2, False), (7, 3, True), (6, None, False), (5, 3, False)], "address long, id long, obsolete boolean")
    assert rows_of(business.with_subject(a, s, "id", ["name"])) == [(5, 3, "c"), (9, 1, "a")]


def test_connections(spark):
    c = spark.createDataFrame([(1, "one", True, "s", "k"), (2, "two", True, None, "k"), (3, "three", False, "s", "k")], "id long, name string, active boolean, secrets string, kind string")
    a = spark.createDataFrame([("b", "B", 1, True), ("a", "A", 1, True), ("c", "C", 2, True), ("d", "D", None, True), ("e", "E", 3, True), ("f", "F", 1, False)], "code string, name string, connection long, active boolean")
    assert rows_of(business.to_import(a, c)) == [("a", 1, "k"), ("b", 1, "k")]
    assert {(r["code"], r["connection_name"]) for r in business.with_connection(a, c).collect()} == {("a", "one"), ("b", "one"), ("c", "two"), ("d", None), ("e", "three")}
    lists = {r["id"]: [x["code"] for x in r["companies"]] for r in business.connection_lists(c, a).collect()}
    assert lists == {1: ["a", "b", "f"], 2: ["c"], 3: ["e"]}
    assert [r["companies"] for r in business.connection_lists(c, a.limit(0)).collect()] == [[], [], []]


def test_sources_and_graphs(spark):
    s = spark.createDataFrame([("x",), ("y",)], "id string")
    d = spark.createDataFrame([("x", "indexed", 3), ("x", "error", 9), ("x", "waiting", 4), (None, "error", 1)], "source_id string, state string, updated_at long")
    assert rows_of(reports.source_states(s, d)) == [("x", 1, 1, 9), ("y", 0, 0, None)]
    n = spark.createDataFrame([("a", "K"), ("b", None)], "node string, kind string")
    e = spark.createDataFrame([("a", "b", "r"), ("a", "b", None), ("a", "nowhere", "r")], "src string, dst string, relation string")
    assert rows_of(reports.edge_kinds(n, e)) == [("K", "", "?", 1), ("K", "r", "?", 1)]


def test_backfill_writes_each_piece_once(spark):
    kinds = "source_id string, document string, page int, content string"
    c = spark.createDataFrame([("s", "d", 1, "old"), ("s", "d", None, "same")], kinds)
    p = spark.createDataFrame([("s", "d", None, "same"), ("s", "d", 2, "same"), ("s", "d", 2, "same"), ("s", "d", 1, "new")], kinds)
    once = ingest.backfilled(c, p)
    assert rows_of(once) == rows_of(ingest.backfilled(once, p)) and once.count() == 4


@pytest.mark.parametrize("size, night, gpu, most, want", [(60, False, False, 50, True), (60, True, False, 50, False), (60, False, True, 50, False), (60, False, False, 0, False), (40, False, False, 50, False)])
def test_large_files_wait_for_the_night(spark, size, night, gpu, most, want):
    assert spark.range(1).select(ingest.deferred(F.lit(size * 1024 * 1024), F.lit(night), gpu, most)).first()[0] is want


def test_rounds_tell_what_happened(spark):
    turn, near = retrieval.Rounds(), lambda: spark.createDataFrame([(9,)], "id long")
    some, none = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "id long")
    rows, outcome = turn.run("A  b;", lambda: some, near)
    assert outcome == "done" and rows_of(rows) == [(1, True)]
    assert turn.run("a B", lambda: some, near) == (None, "repeated") and turn.run(" ; ", lambda: some, near) == (None, "refused")
    assert turn.run("bad", lambda: some.where("nothing = 1"), near) == (None, "refused")
    assert turn.run("bad", lambda: some.where("id = 1"), near)[1] == "done"  # a refused search was never done
    rows, outcome = turn.run("none", lambda: none, near)
    assert outcome == "empty" and rows_of(rows) == [(9, False)]


def test_messages_and_sizes(spark):
    kinds = "c array<struct<attribute: string, value: string>>, q string"
    cases = [
        (None, "Quali nastri avete?", "articoli che corrispondono alla tua richiesta", 120), ([], "il prezzo", "articoli che corrispondono alla tua richiesta", 60),
        ([("misura", "10 cm"), ("colore", "rosso")], "che colori ci sono", "articoli di colore 10 cm, rosso", 120), ([("colore", ""), ("prezzo", "5")], None, "articoli con prezzo 5", 60),
        ([("formato", "A4")], "tutte le tazze", "articoli della misura A4", 120), ([("peso", None)], "la gamma", "articoli con quelle caratteristiche", 120),
    ]
    df = spark.createDataFrame([(c, q) for c, q, _, _ in cases], kinds)
    got = df.select(retrieval.nothing_found(F.col("c")), retrieval.pieces_wanted(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(f"Nei documenti a cui ho accesso non ho trovato {said}.", n) for _, _, said, n in cases]


def test_exports_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"\\', (1, "x")), (2, "", (None, None)), (3, None, None)], "id long, t string, s struct<a: int, b: string>")
    files.export_csv(df, str(tmp_path / "e"))
    raw = next((tmp_path / "e").glob("part-*.csv")).read_bytes()
    assert raw.startswith("﻿id;t;s".encode())
    back = files.read_export(spark, str(tmp_path / "e")).orderBy("id").collect()
    assert [r["id"] for r in back] == ["1", "2", "3"] and back[0]["t"] == 'a;"b"\\' and back[0]["s"] == '{"a":1,"b":"x"}'


def test_current_views(spark):
    own = spark.newSession()
    rows = own.createDataFrame([("1", "c", "now", None, False), ("2", "c", "gone", None, True), ("1", "c", "was", "2020-01-01", False)], "id string, company string, name string, valid_to string, deleted boolean").withColumn("row_hash", F.lit("")).withColumn("valid_from", F.lit(""))
    assert history.current_views(own, {"things": rows}) == ["current_things"]
    assert rows_of(own.sql("SELECT * FROM current_things")) == [("1", "c", "now")]


def test_a_right_that_is_gone_hides_the_figure(spark):
    from tessera.functions import acl

    figures = spark.createDataFrame([(1, "s"), (2, "t")], "id long, source_id string")
    ids, who = spark.createDataFrame([(1,), (2,), (3,)], "id long"), acl.Principal.of(["all", "company-n"])
    kinds = "id string, acl_groups array<string>, companies array<string>, state string"
    s = lambda state: spark.createDataFrame([("s", ["all"], ["n"], state), ("t", ["x"], ["n"], "active")], kinds)
    assert rows_of(retrieval.visible(ids, figures, s("active"), who)) == [(1,)] and rows_of(retrieval.visible(ids, figures, s("suspended"), who)) == []

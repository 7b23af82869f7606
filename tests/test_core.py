"""Rules of access, history, ingestion, pieces and anomalies on fixed cases and random rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import acl, text, vectors
from tessera.operators import anomalies, chunking, history, ingest, retrieval
from tessera.sources import connectors, files

SOURCES = "id string, acl_groups array<string>, companies array<string>, state string"
CHUNKS = "id long, source_id string, document string, page int, content string, embedding array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    s = spark.createDataFrame(
        [
            ("tides", ["crew"], ["north"], "active"),  # read by all crew
            ("ledger", ["clerks", "captains"], ["north"], "active"),  # by two groups
            ("drafts", ["crew"], ["north"], "waiting"),  # not released
            ("abroad", ["crew"], ["south"], "active"),  # of another fleet
            ("notes", ["crew", None], ["north"], "active"),  # a null among its groups
        ],
        SOURCES,
    )
    c = spark.createDataFrame(
        [
            (1, "tides", "almanac", 40, "High water at pier 9 is 75% of spring_tide", [0.0, 1.0]),
            (2, "ledger", "tolls", 2, "Toll for ships at the pier", [0.1, 0.9]),
            (3, "drafts", "plan", 7, "A longer pier for the ferry", [0.0, 1.0]),
            (4, "abroad", "harbour", 7, "High water at the stone pier", [0.0, 1.0]),
            (5, "notes", "almanac", None, "No ferry; the pier is closed", None),
        ],
        CHUNKS,
    )
    return s, c


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_access_decides_inside_the_query(spark, tables):
    s, c = tables
    clerk = acl.Principal.of(["clerks", "company-north"])
    sailor = acl.Principal.of(["crew", "company-north"])
    assert ids(acl.secured(c, s, clerk)) == [2] and ids(acl.secured(c, s, sailor)) == [1, 5]
    assert ids(acl.secured(c, s, acl.Principal.of(["crew"]))) == [] and ids(acl.secured(c, s, acl.Principal((), ("north",)))) == []
    df = text.document_frequency(c)
    rows, degraded = retrieval.hybrid_search(c, s, df, c.count(), sailor, "which pier", [0.0, 1.0], divisor=1)
    assert not degraded and set(ids(rows)) <= {1, 5}
    rows, degraded = retrieval.hybrid_search(c, s, df, c.count(), sailor, "which pier", None, divisor=1)
    assert degraded and ids(rows) == [1, 5]


def test_more_groups_never_show_less(tables):
    s, c = tables
    groups, seen = [], set()
    for g in ("company-north", "crew", "clerks", "company-south"):
        groups.append(g)
        now = set(ids(acl.secured(c, s, acl.Principal.of(groups))))
        assert seen <= now
        seen = now


def test_guard(spark, tables):
    s, c = tables
    who = acl.Principal.of(["crew", "company-north"])
    allowed = {"document", "page", "content"}
    rows = retrieval.guarded_select(c, s, who, ["document"], allowed, (F.col("page") == 40) | F.lit(True))
    assert ids(rows) == [1, 5]
    for columns in (["embedding"], ["source_id"]):
        with pytest.raises(ValueError):
            retrieval.guarded_select(c, s, who, columns, allowed | {"source_id"} - {"embedding"})
    for hidden in (F.col("source_id") == "tides", c["source_id"] == "tides", F.size("embedding") > 0, F.expr("source_id like 't%'")):
        with pytest.raises(ValueError):
            retrieval.guarded_select(c, s, who, ["document"], allowed, hidden)
    rows_of = lambda x: spark.createDataFrame(c.collect(), CHUNKS) if x is spark else x.createDataFrame(c.collect(), CHUNKS)
    sources_of = lambda x: x.createDataFrame(s.collect(), SOURCES)
    sailor = acl.secure_session(spark, {"visible": rows_of}, sources_of, who)
    clerk = acl.secure_session(spark, {"visible": rows_of}, sources_of, acl.Principal.of(["clerks", "company-north"]))
    sql = "select a.id from visible a, visible b where a.id = 4 or b.id = 3 or true"
    assert ids(sailor.sql(sql).distinct()) == [1, 5] and ids(clerk.sql(sql).distinct()) == [2]
    assert not spark.catalog.tableExists("visible")


def test_literal_search_has_no_wildcards(tables):
    _, c = tables
    assert ids(retrieval.exact_search(c, "75%", 9)) == [1] and ids(retrieval.exact_search(c, "spring_tide", 9)) == [1] and ids(retrieval.exact_search(c, "spring%tide", 9)) == []


def test_constraint_is_soft_and_documents_hard(tables):
    s, c = tables
    who, df = acl.Principal.of(["crew", "company-north"]), text.document_frequency(c)
    find = lambda **k: ids(retrieval.hybrid_search(c, s, df, c.count(), who, "pier", None, divisor=1, **k)[0])
    assert find(pattern="(?i)high water") == [1] and find(pattern="nothing like it") == [1, 5] and find(documents=["zzz"]) == []


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [-3.0, 0.0]), (6, [2.0, 0.0])], "id long, embedding array<float>")
    got = [(r["id"], r["distance"], r["rank"]) for r in vectors.nearest(df, [1.0, 0.0], 10).orderBy("rank").collect()]
    assert got == [(1, 0.0, 1), (6, 0.0, 2), (2, 1.0, 3), (5, 2.0, 4)]


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    one, two = ({r["id"]: r["points"] for r in retrieval.fused(x).collect()} for x in ([a, b], [b, a]))
    assert one == two and one[2] == round(1 / 61 + 1 / 62, 6)


HISTORY = "id string, company string, name string, row_hash string, valid_from timestamp_ntz, valid_to timestamp_ntz, deleted boolean"


def load(spark, **rows):
    return spark.createDataFrame([(k, "c", v) for k, v in rows.items()], "id string, company string, name string")


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def test_history_life(spark):
    h = spark.createDataFrame([], HISTORY)
    step = lambda h, day, full, **rows: spark.createDataFrame(history.merge(h, load(spark, **rows), at(day), full).collect(), HISTORY)
    h = step(h, 1, True, a="x", b="y")
    assert h.count() == 2
    again = step(h, 2, True, a="x", b="y")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, h.collect()), key=repr)
    h = step(h, 3, True, a="X")
    assert ids(history.current(h)) == ["a"] and h.where("deleted").count() == 1 and h.count() == 4
    h = step(h, 4, False, c="z")
    assert ids(history.current(h)) == ["a", "c"]
    h = step(h, 5, True, a="X", b="y", c="z")  # b comes back
    assert ids(history.current(h)) == ["a", "b", "c"] and h.where("deleted and valid_to is null").count() == 0
    assert history.broken_intervals(h).count() == 0 and h.where("valid_to is null").groupBy("id").count().where("count > 1").count() == 0
    assert ids(history.as_of(h, at(2))) == ["a", "b"] and ids(history.as_of(h, at(3))) == ["a"]


def test_hash_and_checks(spark):
    df = spark.createDataFrame([("1", "c", "n", None), ("2", "c", "n", None), ("3", "c", "n", ""), ("4", "c", "m", None)], "id string, company string, name string, extra string")
    h = {r["id"]: r["h"] for r in df.select("id", history.row_hash(history.business_columns(df)).alias("h")).collect()}
    assert h["1"] == h["2"] and len(set(h.values())) == 3
    assert history.collapsed(100, 1) and not history.collapsed(100, 50) and not history.collapsed(1, 0)
    assert history.nonconforming({"a", "iban"}, {"a"}, {"iban"}) == ["iban"]
    bad = spark.createDataFrame([("1", "c", "n", "h", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), False), ("1", "c", "n", "h", dt.datetime(2024, 1, 2), None, False)], HISTORY)
    assert history.broken_intervals(bad).count() == 1
    inside = spark.createDataFrame([("1", "c", "n", "h", dt.datetime(2024, 1, a), dt.datetime(2024, 1, b), False) for a, b in ((1, 9), (2, 3), (4, 5), (9, 10))], HISTORY)
    assert history.broken_intervals(inside).count() == 2
    ties = spark.createDataFrame([("1", 1, v) for v in "abcdef"], "id string, at int, v string")
    assert len({history.last_wins(ties.repartition(n), "id", "at").first()["v"] for n in (1, 2, 5)}) == 1


def test_differences(spark):
    s = "path string, size long, mtime long, hash string"
    present = spark.createDataFrame([("same", 1, 1, "h1"), ("touched", 1, 9, "h2"), ("changed", 2, 9, "h3x"), ("new", 1, 1, "h9"), ("to", 1, 1, "h4"), ("copy", 1, 1, "h1")], s)
    known = spark.createDataFrame([("same", 1, 1, "h1"), ("touched", 1, 1, "h2"), ("changed", 1, 1, "h3"), ("from", 1, 1, "h4"), ("gone", 1, 1, "h5")], s)
    got = {(r["path"], r["state"], r["old_path"]) for r in ingest.differences(present, known).collect()}
    assert got == {("same", "unchanged", None), ("touched", "touched", None), ("changed", "changed", None), ("new", "new", None), ("to", "moved", "from"), ("copy", "duplicate", None), ("gone", "removed", None)}


def test_files_in_and_out(spark, tmp_path):
    folder = tmp_path / "docs"
    for name, body in {"a/one.txt": "x\n\ny", "a/_hidden.txt": "n", ".b/c.txt": "n", "two.MD": "# t", "~$tmp.docx": "n", "old.xls": "n", "x.exe": "n"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(body)
    rows = {(r["path"], r["reader"]) for r in files.scanned(spark, str(folder)).collect()}
    assert rows == {("a/one.txt", "text"), ("two.MD", "layout"), ("old.xls", "excluded")}
    (tmp_path / "conn/x").mkdir(parents=True)
    (tmp_path / "conn/x/manifest.json").write_text('{"connector": "x", "entities": {"orders": {"strategy": "full", "tables": ["o", "l"]}}}')
    assert [tuple(r) for r in files.catalogue(spark, str(tmp_path / "conn")).collect()] == [("x", "orders", "full", ["o", "l"])]
    day = spark.createDataFrame([("d1", 1), ("d2", 1)], "day string, n int")
    files.write_snapshot(day, str(tmp_path / "snap"))
    files.write_snapshot(day.where("day = 'd2'").withColumn("n", F.lit(5)), str(tmp_path / "snap"))
    assert sorted((r["day"], r["n"]) for r in spark.read.parquet(str(tmp_path / "snap")).collect()) == [("d1", 1), ("d2", 5)]
    files.append_log(day, str(tmp_path / "log"))
    files.append_log(day, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    files.export_csv(day.withColumn("s", F.struct("n")).coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "csv")).columns == ["day", "n", "s"]
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfday;n;s")
    read = spark.createDataFrame([(["A", " ", "b"], "text", [4, 5]), ([], "alone", [])], "headings array<string>, text string, pages array<int>")
    assert [tuple(r) for r in files.chunks_under_headings(read).collect()] == [("A > b\ntext", 4), ("alone", None)]
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None)], "id long, modified_at timestamp")
    assert ids(connectors.extracted(rows, "c", "2024-01-02 00:00:00")) == [2, 3]


def test_pieces():
    assert chunking.merged([("Harbour rules", 1), ("line  one", 1), ("line two", 2), ("  ", 2), (None, 2)]) == [("Harbour rules\nline one", 1), ("line two", 2)]
    got = chunking.merged([("Rope, sold by metre", 7), ("Sturdy hemp rope", 7), ("RP100 hemp", 7), ("RP200 flax", 7), ("noise", 7)])
    assert [t for t, _ in got] == ["Rope, sold by metre\nSturdy hemp rope", "Rope, sold by metre | RP100 hemp", "Rope, sold by metre | RP200 flax", "noise"]
    got = chunking.merged([("RP100 hemp", 3), ("t" * 250, 3)])
    assert got[0][0] == "t" * 200 + " | RP100 hemp" and got[1][0] == "t" * 250
    assert chunking.merged([("ISO 9001 asks for a yearly look at the rules", 1)]) == [("ISO 9001 asks for a yearly look at the rules", 1)]
    assert all(len(t) <= chunking.MOST for t, _ in chunking.merged([("w" * 5000, 1), ("x " * 3000, 2)]))
    md = "# Buoys\nfor rivers\n\n- red\n- blue\n- green\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSome prose\nmore"
    assert chunking.markdown_pieces(md) == ["Buoys for rivers | red", "Buoys for rivers | blue", "Buoys for rivers | green", "Buoys for rivers\n| a | b |\n|---|---|\n| 1 | 2 |", "Buoys for rivers\nSome prose\nmore"]
    big = "# T\n| h |\n|---|\n" + "\n".join(f"| row {i} {'x' * 40} |" for i in range(60))
    pieces = chunking.markdown_pieces(big)
    assert len(pieces) == 60 and all(p.startswith("T | | h | | | row") for p in pieces)
    assert chunking.markdown_pieces("```\n---\n```") == [] and chunking.markdown_pieces(None) == []
    words = " ".join(f"w{i}" for i in range(400))
    assert sum(p.count("w") for p in chunking.markdown_pieces(f"# head\n{words}")) >= 400 and chunking.markdown_pieces("# only\n## heads") == ["only", "heads"]


@pytest.mark.parametrize("seed", range(40))
def test_pages_lose_no_word(seed):
    """Every word of a page but fences and rules is in a piece, and all but those of titles and headers in one only."""
    rng = random.Random(seed)
    kinds = ["# {}", "{}", "- {}", "| {} | {} |", "", "---", "{} {} {}", "{} " * 150, "## {} {}"]
    n, lines = 0, []
    for _ in range(rng.randrange(1, 40)):
        line = rng.choice(kinds)
        k = line.count("{}")
        lines.append(line.format(*[f"w{n + i}q" for i in range(k)]))
        n += k
    pieces = chunking.markdown_pieces("\n".join(lines))
    assert all(any(f"w{i}q" in p for p in pieces) for i in range(n)) and all(len(p) <= chunking.MOST + 300 for p in pieces)
    merged = chunking.merged([(x, i % 2) for i, x in enumerate(lines)])
    assert all(any(f"w{i}q" in p for p, _ in merged) for i in range(n)) and all(len(p) <= chunking.MOST for p, _ in merged)


def test_texts_are_folded_where_they_are(spark):
    rows = [("a", 1, "Rope by the metre, plain\nRP100 hemp\n\nmore"), ("b", None, None), ("c", 2, "x " * 4000)]
    out = chunking.merge_texts(spark.createDataFrame(rows, "document string, page int, content string"))
    got = {d: [p for k, p in sorted((r["ord"], r["piece"]) for r in out.collect() if r["document"] == d)] for d in "abc"}
    assert got["a"] == ["Rope by the metre, plain", "Rope by the metre, plain | RP100 hemp", "more"] and got["b"] == []
    assert "Exchange" not in out._jdf.queryExecution().toString() and sum(p.count("x") for p in got["c"]) == 4000


def test_ranks_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random(), float(rng.randrange(3))] if i % 9 else None) for i in range(700)] + [(900 + i, [1.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {r["id"]: r["rank"] for r in vectors.ranked(df, [1.0, 0.5], ranges=16).collect()}
    want = {r["id"]: r["rank"] for r in vectors.nearest(df, [1.0, 0.5], 1000).collect()}
    assert got == want and vectors.ranked(df.limit(0), [1.0, 0.5]).collect() == []


def test_one_dimension(spark):
    with pytest.raises(ValueError):
        ingest.one_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))


SIGNALS = "fingerprint string, at timestamp, kind string, until timestamp, seq long"


def day(n):
    return dt.datetime(2024, 1, n)


CASES = [
    ("a", [("signal", 1, None)] * 3, ("open", 3, False, 0)),
    ("b", [("signal", 1, None), ("resolve", 2, None), ("signal", 3, None)], ("open", 2, False, 1)),
    ("c", [("signal", 1, None), ("ignore", 2, 10), ("signal", 3, None)], ("ignored", 2, False, 0)),
    ("d", [("signal", 1, None), ("ignore", 2, 4), ("signal", 5, None)], ("open", 2, False, 1)),
    ("e", [("signal", 1, None), ("take", 2, None), ("close", 3, None), ("close", 4, None)], ("resolved", 1, True, 0)),
    ("f", [("close", 1, None)], None),
    ("g", [("signal", 1, None), ("ignore", 2, None), ("signal", 9, None)], ("ignored", 2, False, 0)),
]


def signals(spark, which=lambda i: True):
    rows = [(k, day(d), kind, day(u) if u else None, i) for k, steps, _ in CASES for i, (kind, d, u) in enumerate(steps) if which(i)]
    return spark.createDataFrame(rows, SIGNALS)


def test_anomaly_fold(spark):
    got = {r["fingerprint"]: (r["state"], r["occurrences"], r["auto"], r["reopened"]) for r in anomalies.folded(signals(spark)).collect()}
    assert got == {k: want for k, _, want in CASES if want}


def test_text_helpers(spark):
    df = spark.createDataFrame([("Città È bella, costa 12,50 e non 300.00. AB12 ab3 XY9",)], "t string")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(text.plain(F.col("t"))).startswith("citta e bella costa") and one(text.codes(F.col("t"))) == ["AB12", "XY9"]
    assert one(text.price_below(F.col("t"), 13)) and not one(text.price_below(F.col("t"), 12.5))
    assert one(F.col("t").rlike(text.whole_word("BELLA,"))) and not one(F.col("t").rlike(text.whole_word("bell")))
    assert text.expanded_query("red chair", ["chair", "oak"], ["oak", "wood"]) == "red chair oak wood"
    assert one(F.lit("abc").rlike(text.any_word(["two words"]))) is False


def test_whole_load(spark):
    schema = "id string, company string, parent string, name string, seq long"
    rows = [(str(i), "c", "7", "n", 0) for i in range(10)] + [("1", "c", None, "later", 1), (None, "c", None, "no id", 2)]
    empty = spark.createDataFrame([], "id string, company string, parent string, name string, row_hash string, valid_from timestamp_ntz, valid_to timestamp_ntz, deleted boolean")
    h, outcome = history.load(empty, spark.createDataFrame(rows, schema), ["parent"], "seq", at(1), True)
    got = {r["id"]: (r["parent"], r["name"]) for r in h.collect()}
    assert outcome == "ok" and len(got) == 10 and got["c:1"] == (None, "later") and got["c:2"] == ("c:7", "n")
    h = spark.createDataFrame(h.collect(), empty.schema)
    assert history.load(h, spark.createDataFrame(rows[:1], schema), ["parent"], "seq", at(2), True) == (None, "collapsed by 90 %")
    assert history.load(h, spark.createDataFrame(rows[:1], schema), ["parent"], "seq", at(2), False)[1] == "ok"


def test_few_texts_are_cut_at_once(spark):
    rows = [("d", i, "x " * 1000) for i in range(200)] + [("n", None, None)]
    out = chunking.merge_texts(spark.createDataFrame(rows, "document string, page int, content string").coalesce(1))
    assert "MapInArrow" in out._jdf.queryExecution().toString() and chunking.AT_ONCE <= 64
    assert {r["page"]: r["n"] for r in out.groupBy("page").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: 2 for i in range(200)}

"""Quotation linking: known cases, and DuckDB on the same rows."""

import random
import time

import duckdb

from tessera.llm import quotes
from tessera.llm.quotes import ORACLE_SQL, op1_quotes, reply_ordered

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in reply_ordered(df).collect()}


def test_nested_quotes(spark):
    got = rows_of(
        spark,
        [
            (1, 0, "a", "Shall we meet on Monday? Bring the plans."),
            (1, 1, "b", "Ann wrote:\n> Shall we meet\n> on Monday?  Bring the plans.\nYes, at nine."),
            (1, 2, "c", "On Tue Bob wrote:\n>> Shall we meet on Monday?\n> Yes, at nine.\n\nToo early."),
            (1, 3, "d", "> too EARLY\r\nThen ten."),
            (2, 0, "e", "> Then ten.\nforwarded"),
            (2, 1, "f", "> never said\nhello"),
        ],
    )
    assert [got[k]["text"] for k in ((1, 1), (1, 2), (1, 3), (2, 0))] == ["Yes, at nine.", "Too early.", "Then ten.", "forwarded"]
    assert [(got[k]["parent_conv"], got[k]["parent_turn"]) for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1))] == [(None, None), (1, 0), (1, 1), (1, 2), (1, 3), (None, None)]
    assert [got[k]["depth"] for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1))] == [0, 1, 2, 3, 4, 0]
    assert {(got[k]["thread_conv"], got[k]["thread_turn"]) for k in ((1, 2), (1, 3), (2, 0))} == {(1, 0)}
    assert got[(1, 2)]["deepest_quote"] == 2 and got[(2, 1)]["n_quotes"] == 1 and got[(2, 1)]["n_linked"] == 0


def test_odd_rows(spark):
    got = reply_ordered(spark.createDataFrame([(1, 0, "a", "hello there", "z"), (1, 0, "a", "hello there", "z"), (1, 1, None, None, None), (None, 3, "b", "> hello there", "z"), (4, None, "b", "> hello there\nx", "z"), (5, 0, "c", "word. " * 30000, "z"), (6, 0, "c", "> " + "word. " * 30000, "z")], SCHEMA)).collect()
    assert len(got) == 7 and sum(r["parent_conv"] is not None for r in got) == 1
    assert reply_ordered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_lines_of_alternating_levels(spark):
    """Time is linear in the lines: a message of 20,000 lines takes seconds."""
    lines = [("> " if i % 2 else "") + f"line {i}" for i in range(20_000)]
    began = time.time()
    got = rows_of(spark, [(1, 0, "a", "line 7"), (1, 1, "b", "\n".join(lines))])
    assert time.time() - began < 30
    assert got[(1, 1)]["n_quotes"] == 10_000 and got[(1, 1)]["n_linked"] == 1 and got[(1, 1)]["text"] == "\n".join(lines[::2])


def test_long_chain_of_replies(spark):
    rows = [(7, i, "a", f"> message number {i - 1}\nmessage number {i}" if i else "message number 0") for i in range(70)]
    got = rows_of(spark, rows)
    assert all(got[(7, i)]["depth"] == i and got[(7, i)]["thread_turn"] == 0 for i in range(70))


def test_against_duckdb(spark, tmp_path):
    rng = random.Random(4)
    words = "plan meet Monday report draft été budget 12 yes no later".split()
    rows, said = [], []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if said:
                    level = rng.randrange(1, 4)
                    if rng.random() < 0.3:
                        lines.append("On Friday X wrote:")
                    lines += [">" * level + " " * rng.randrange(2) + x for x in rng.choice(said).split("\n")]
            text = "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(".!?,") for _ in range(rng.randrange(0, 4)))
            lines += text.split("\n")
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["\n", "\r\n"]).join(lines), "x"))
    rows.append((3, 99, None, None, None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL)
    names = [d[0] for d in want.description]
    want = want.fetchall()
    got = [tuple(r) for r in op1_quotes(spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] is not None for r in got) > 10


def test_a_sentence_that_everyone_quotes_is_split(spark, monkeypatch):
    """The joins of quoted units take several tasks for one hot sentence; links stay right."""
    plans = []

    def spy(df, label, *rest, real=quotes.written):
        if label == "quote-units":
            frame = df.selectExpr("*")
            frame.collect()
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *rest)

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(quotes, "written", spy)
    rows = [(0, 0, "user", "The tide is high tonight.")] + [(0, i, "user", "> The tide is high tonight.\nSo it is, said number %d." % i) for i in range(1, 8000)] + [(i, 0, "user", f"Own words {i}.") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = quotes.quote_links(quotes.written(quotes.parsed_messages(df), "messages"))
        one = got.groupBy("parent_conv", "parent_turn").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in one] == [(0, 0, 7999)]
    assert any("skew=true" in p for p in plans)

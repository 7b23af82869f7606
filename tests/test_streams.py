"""The anomaly stream against the batch fold: disorder, late rows, restarts, timers, the table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import anomalies
from tessera.streaming import anomalies as stream

SIGNALS = "fingerprint string, at timestamp, kind string, until timestamp, seq long"
T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
KINDS = ["signal", "signal", "close", "take", "resolve", "ignore", "reopen"]


def random_signals(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(KINDS)
        until = T(i + rng.randrange(1, 40)) if kind == "ignore" and rng.random() < 0.8 else None
        rows.append((rng.choice("abcdefg"), T(i // 2), kind, until, i))
    return rows


def written_in_parts(spark, path, rows, parts, rng, late):
    """Files in order of time, but each row may come up to ``late`` rows later than its place."""
    arrival = sorted(range(len(rows)), key=lambda i: i + rng.random() * late)
    size = len(rows) // parts + 1
    for k in range(parts):
        spark.createDataFrame([rows[i] for i in arrival[k * size : (k + 1) * size]], SIGNALS).coalesce(1).write.mode("append").parquet(path)
        yield k


def tick(spark, path, at):
    spark.createDataFrame([("", at, "tick", None, 0)], SIGNALS).coalesce(1).write.mode("append").parquet(path)


def started(spark, table, path, checkpoint, late, initial=None):
    source = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(path)
    table.follow(stream.folded_stream(source, late, initial), checkpoint).awaitTermination()


def states(df):
    return {r["fingerprint"]: tuple(r[c] for c in ("state", "occurrences", "first_at", "last_at", "ignored_until", "auto", "reopened")) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_after_restarts_and_late_rows(spark, tmp_path, seed):
    rows, rng = random_signals(seed), random.Random(seed)
    path, table = str(tmp_path / "in"), stream.StateTable(spark, str(tmp_path / "table"), 3)
    for k in written_in_parts(spark, path, rows, 4, rng, 30):
        if k == 3:
            tick(spark, path, T(5000))
        if k in (1, 3):  # two runs, the second from the checkpoint
            started(spark, table, path, str(tmp_path / "cp"), "24 hours")
    want = anomalies.folded(spark.createDataFrame(rows, SIGNALS))
    assert states(table.read()) == states(want)
    lapsed = {r["fingerprint"]: r["lapsed"] for r in stream.begun_with(want, F.lit(T(5000))).collect()}
    assert {r["fingerprint"]: r["lapsed"] for r in table.read().collect()} == lapsed


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    path, table = str(tmp_path / "in"), stream.StateTable(spark, str(tmp_path / "table"), 2)
    spark.createDataFrame([("a", T(1), "signal", None, 0)], SIGNALS).coalesce(1).write.parquet(path)
    tick(spark, path, T(100))
    started(spark, table, path, str(tmp_path / "cp"), "1 hour")
    spark.createDataFrame([("a", T(2), "resolve", None, 1), ("a", T(120), "signal", None, 2)], SIGNALS).coalesce(1).write.mode("append").parquet(path)
    tick(spark, path, T(200))
    started(spark, table, path, str(tmp_path / "cp"), "1 hour")
    assert [(r["state"], r["occurrences"]) for r in table.read().collect()] == [("open", 2)]


def test_a_timer_ends_ignored_until(spark, tmp_path):
    path, table, checkpoint = str(tmp_path / "in"), stream.StateTable(spark, str(tmp_path / "table"), 2), str(tmp_path / "cp")
    spark.createDataFrame([("a", T(1), "signal", None, 0), ("a", T(2), "ignore", T(50), 1), ("b", T(1), "signal", None, 2), ("b", T(2), "ignore", None, 3)], SIGNALS).coalesce(1).write.parquet(path)
    tick(spark, path, T(20))
    started(spark, table, path, checkpoint, "1 hour")
    read = lambda: {r["fingerprint"]: (r["state"], r["lapsed"]) for r in table.read().collect()}
    assert read() == {"a": ("ignored", False), "b": ("ignored", False)}
    tick(spark, path, T(80))  # no signal of either comes
    started(spark, table, path, checkpoint, "1 hour")
    assert read() == {"a": ("ignored", True), "b": ("ignored", False)}
    spark.createDataFrame([("a", T(90), "signal", None, 4), ("b", T(90), "signal", None, 5)], SIGNALS).coalesce(1).write.mode("append").parquet(path)
    tick(spark, path, T(100))
    started(spark, table, path, checkpoint, "1 hour")
    assert read() == {"a": ("open", False), "b": ("ignored", False)}


def test_a_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = random_signals(5, 200)
    first, second = [r for r in rows if r[1] < T(60)], [r for r in rows if r[1] >= T(60)]
    begun = stream.begun_with(anomalies.folded(spark.createDataFrame(first, SIGNALS)), F.lit(T(60)))
    table = stream.StateTable(spark, str(tmp_path / "table"), 2)
    table.upsert(begun)
    path = str(tmp_path / "in")
    spark.createDataFrame(second, SIGNALS).coalesce(1).write.parquet(path)
    tick(spark, path, T(5000))
    started(spark, table, path, str(tmp_path / "cp"), "1 hour", begun)
    assert states(table.read()) == states(anomalies.folded(spark.createDataFrame(rows, SIGNALS)))


def test_upserts_are_idempotent_and_the_later_step_wins(spark, tmp_path):
    table = stream.StateTable(spark, str(tmp_path / "t"), 2)
    row = lambda f, state, step: (f, state, step, None, None, None, False, 0, False, step)
    make = lambda *rows: spark.createDataFrame(list(rows), stream.STEPS)
    table.upsert(make(row("a", "open", 1), row("a", "taken", 2), row("b", "open", 1)))
    one = sorted(map(tuple, table.read().collect()))
    table.upsert(make(row("a", "open", 1)))
    table.upsert(make(row("a", "open", 1), row("a", "taken", 2), row("b", "open", 1)))
    table.upsert(make())
    assert sorted(map(tuple, table.read().collect())) == one and [r[1] for r in one] == ["taken", "open"]


ACTIONS = "seq long, at timestamp, fingerprint string, actor string, action string, text string, target string, until string"


def test_manual_actions(spark):
    held = spark.createDataFrame([("a", "acme", "open", None, None, True), ("b", None, "ignored", "eve", T(9), True), ("c", "borea", "open", None, None, True), ("d", "acme", "resolved", None, None, True)], "fingerprint string, company string, state string, assigned_to string, ignored_until timestamp, auto boolean")
    actions = [
        (1, T(1), "a", "ann", "take", None, None, None), (2, T(2), "a", "ann", "comment", " ", None, None), (3, T(3), "a", "ann", "comment", "looking", None, None),
        (4, T(4), "b", "bob", "resolve", None, None, None), (5, T(5), "c", "ann", "take", None, None, None), (6, T(6), "nobody", "ann", "take", None, None, None),
        (7, T(7), "a", "bob", "assign", None, " ", None), (8, T(8), "a", "bob", "assign", None, "cy", None), (9, T(9), "d", "bob", "ignore", "", None, "7d"),
        (10, T(10), "d", "bob", "ignore", "noise", None, "soon"), (11, T(11), "d", "bob", "ignore", "noise", None, "7d"), (12, T(12), "a", "bob", "erase", None, None, None),
        (13, T(13), "a", "bob", "ignore", "known", None, "always"), (14, T(14), "a", "bob", "comment", "later", None, None),
    ]
    judged = anomalies.judged(held, spark.createDataFrame(actions, ACTIONS), ["acme"])
    said = {r["seq"]: r["outcome"] for r in judged.collect()}
    assert [s for s, o in said.items() if o.startswith("refused")] and {s: said[s] for s in (2, 5, 6, 7, 9, 10, 12)} == {2: "refused: empty comment", 5: "refused: no such anomaly", 6: "refused: no such anomaly", 7: "refused: to whom?", 9: "refused: a reason is needed", 10: "refused: until when?", 12: "refused: unknown action"}
    after = {r["fingerprint"]: tuple(r)[2:] for r in anomalies.acted(held, judged).collect()}
    assert after == {"a": ("ignored", "cy", None, True), "b": ("resolved", "eve", None, False), "c": ("open", None, None, True), "d": ("ignored", None, T(11 + 7 * 24), True)}
    log = {(r["fingerprint"], r["event"], r["is_change"]) for r in anomalies.log_of(judged).collect()}
    assert ("a", "commented", False) in log and ("a", "assigned", True) in log and len(log) == 6


def test_a_key_has_one_timer_for_all_its_waiting_signals():
    """What a batch costs grows with its keys and rows, not with timers that each read the whole list."""
    calls = {"timer": [], "get": 0}

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Waiting:
        items = ()

        def exists(self):
            return bool(self.items)

        def get(self):
            calls["get"] += 1
            return iter(self.items)

        def put(self, items):
            self.items = list(items)

        def appendValue(self, item):
            self.items = [*self.items, item]

        def clear(self):
            self.items = ()

    class Handle:
        def registerTimer(self, ms):
            calls["timer"].append(ms)

        getValueState = lambda self, *_: Held()
        getListState = lambda self, *_: Waiting()

    class Timers:
        getCurrentWatermarkInMs = lambda self: 600

    fold = stream.Fold()
    fold.init(Handle())
    rows = [{"moment": i * 1000, "seq": i, "kind": "signal", "until": None} for i in range(1000)]
    list(fold.handleInputRows(("a",), iter(rows[::-1]), Timers()))
    assert calls["timer"] == [1]
    (out,) = fold.handleExpiredTimer(("a",), Timers(), None)
    assert (out["occurrences"], out["state"]) == (601, "open") and calls == {"timer": [1, 602], "get": 1}

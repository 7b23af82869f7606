"""Imports: outcomes, marks, and a history that only a good run changes."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import anomalies, imports
from tessera.operators.history import StoredHistory

ROWS = "id string, name string, modified timestamp_ntz"
DAY = [dt.datetime(2024, 1, i) for i in range(1, 10)]


def test_runs_of_an_import(spark, tmp_path):
    kept = StoredHistory(spark, str(tmp_path / "h"), "name string", 4)
    data = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    asked = []

    def run(rows, now, full=False, mark=None):
        def extract(since):
            asked.append(since)
            return rows

        return imports.run_import(kept, "a/items", "a", extract, "modified", now, full, mark)

    held = lambda: sorted((r["id"], r["name"]) for r in kept.current().collect())
    first = run(data(("1", "x", DAY[0]), ("1", "y", DAY[1]), (None, "n", DAY[7]), ("2", None, None)), DAY[3])
    assert first == ("a/items", "ok", "", DAY[7], DAY[3]) and held() == [("a:1", "y"), ("a:2", None)]
    failed = run(data(("1", "z", DAY[2])).withColumn("name", F.raise_error(F.lit("line is down")).cast("string")), DAY[4], mark=DAY[1])
    assert failed[1] == "error" and "line is down" in failed[2] and failed[3] is None and held() == [("a:1", "y"), ("a:2", None)]
    empty = run(data(), DAY[5], mark=DAY[1])
    assert empty == ("a/items", "ok", "", None, DAY[5]) and len(held()) == 2
    missing = imports.run_import(kept, "a/items", "a", lambda since: (_ for _ in ()).throw(KeyError()), "modified", DAY[6], False)
    assert missing[1:3] == ("error", "KeyError")
    whole = run(data(("1", "y", DAY[1]), ("2", "w", DAY[2])), DAY[7], True, DAY[1])
    assert whole == ("a/items", "ok", "", None, DAY[7]) and held() == [("a:1", "y"), ("a:2", "w")]
    assert asked == [None, DAY[1], DAY[1], None]
    status = imports.status_after(spark, imports.status_after(spark, spark.createDataFrame([], imports.STATUS), [first]), [failed])
    assert [tuple(r) for r in status.collect()] == [("a/items", "error", failed[2], DAY[7], DAY[4])]
    states = {r["fingerprint"]: r["state"] for r in anomalies.folded(imports.signals_of(spark, [first, failed])).collect()}
    assert states["import:a/items:error"] == "open"
    states = {r["fingerprint"]: r["state"] for r in anomalies.folded(imports.signals_of(spark, [failed, empty])).collect()}
    assert states["import:a/items:error"] == "resolved"

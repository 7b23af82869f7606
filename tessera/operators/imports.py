"""Imports: an entity is extracted, checked, merged into its stored history, and leaves its status and a signal.

A run ends as ok, blocked (a full load that holds far fewer rows than are known) or
error (the extraction or the load raised). Only ok changes the history, in one
switch, and moves the mark of an incremental entity: the next run extracts what is
behind it. One job writes a history at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.history import StoredHistory, upserted

STATUS = "import string, outcome string, reason string, mark timestamp_ntz, at timestamp_ntz"
REASON_CHARS = 2000


def run_import(store: StoredHistory, name: str, company: str, extract: Callable[[dt.datetime | None], DataFrame], changed: str, now: dt.datetime, full_load: bool, mark: dt.datetime | None = None, references: Sequence[str] = ()) -> tuple:
    """One run of import ``name``: a row of ``STATUS``.

    ``extract`` gets the mark (None on a full load) and returns rows with an id,
    the history's columns and the time ``changed``, by which the last row of an id
    wins. The next mark is the greatest of these times, observed while the rows are
    written, so that a source is read once; rows without a time don't move it.
    An empty text is no reason, a null mark leaves the old one.
    """
    seen = Observation()
    try:
        rows = extract(None if full_load else mark).withColumn("company", F.lit(company)).observe(seen, F.max(F.col(changed).cast("timestamp_ntz")).alias("mark"))
        answer = store.load(rows, list(references), changed, F.lit(now).cast("timestamp_ntz"), full_load)
    except Exception as e:  # whatever a source or the load raises is the run's outcome; the history is as it was
        return name, "error", (str(e) or type(e).__name__)[:REASON_CHARS], None, now
    if answer != "ok":
        return name, "blocked", answer, None, now
    return name, "ok", "", None if full_load else seen.get["mark"], now


def status_after(spark: SparkSession, status: DataFrame, runs: list[tuple]) -> DataFrame:
    """The status table after one run of each of some imports: the old mark stays where a run has none."""
    return upserted(status, spark.createDataFrame(runs, STATUS), "import")


def signals_of(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """Signals for the fold of anomalies: a run that failed or was blocked says so, one that went well closes both."""
    ended = spark.createDataFrame(runs, STATUS)
    kinds = F.explode(F.array(F.lit("error"), F.lit("blocked")))
    rows = ended.select("*", kinds.alias("problem")).where((F.col("outcome") == "ok") | (F.col("outcome") == F.col("problem")))
    kind = F.when(F.col("outcome") == "ok", "close").otherwise("signal")
    return rows.select(F.concat_ws(":", F.lit("import"), "import", "problem").alias("fingerprint"), F.unix_micros(F.col("at").cast("timestamp")).alias("seq"), F.col("at").cast("timestamp").alias("at"), kind.alias("kind"), F.lit(None).cast("timestamp").alias("until"))

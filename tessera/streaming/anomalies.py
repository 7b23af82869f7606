"""The anomaly fold as a stateful stream with timers, its table, and windowed counts with a watermark.

Signals may come late and out of order. They wait in the state until the watermark
has passed them, are then applied in the order of time, and so give the state that
the fold of all signals gives; later ones are left out. A second timer runs to the
end of "ignored until", so that a lapsed decision is seen without a new signal.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.operators.anomalies import STATE, State
from tessera.sources.generations import Generations

#: What a stream says of a fingerprint; ``step`` grows with each change, so that the last word can be told.
STEPS = f"{STATE}, lapsed boolean, step long"
_HELD = "state string, occurrences long, first_at long, last_at long, ignored_until long, auto boolean, reopened long, lapsed boolean, step long"
#: Signals of one key that came in one batch, as columns: one item of the state, whatever their number.
_WAITING = "at array<long>, seq array<long>, kind array<string>, until array<long>"
_MOMENTS = ("first_at", "last_at", "ignored_until")


def _whole(value) -> int | None:
    return None if value is None else int(value)


class Fold(StatefulProcessor):
    """Holds a fingerprint's state and the signals that the watermark hasn't passed yet.

    A key has a timer for the first of its waiting signals, not one for each: when
    it ends, all signals that the watermark has passed are applied at once.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _load(self) -> tuple[State, bool, int]:
        found = self.held.get()
        if found is None:
            return State(), False, 0
        *values, lapsed, step = found
        state, occurrences, first, last, until, auto, reopened = values
        return State(state, int(occurrences), _whole(first), _whole(last), _whole(until), bool(auto), int(reopened)), bool(lapsed), int(step)

    def _keep(self, state: State, lapsed: bool, step: int) -> None:
        self.held.update((*asdict(state).values(), lapsed, step))

    def _wait(self, rows: list[tuple]) -> tuple:
        """``rows`` (at, seq, kind, until) as one item of the state, with a timer for the first of them."""
        self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)
        return tuple(list(c) for c in zip(*rows, strict=True))

    def _wake_at_the_end(self, state: State) -> None:
        if state.state == "ignored" and state.ignored_until is not None:
            self.handle.registerTimer(state.ignored_until // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        state = State(r["state"], int(r["occurrences"]), *[_whole(r[c]) for c in _MOMENTS], bool(r["auto"]), int(r["reopened"]))
        self._keep(state, bool(r["lapsed"]), int(r["step"]))
        self._wake_at_the_end(state)

    def handleInputRows(self, key, rows, timerValues):
        self.waiting.appendValue(self._wait([(int(r["moment"]), int(r["seq"]), r["kind"], _whole(r["until"])) for r in rows]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for item in self.waiting.get() for r in zip(*item, strict=True)] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[1]))
        state, lapsed, step = self._load()
        before = (state.state, lapsed)
        for at, _, kind, until in due:
            state.apply(kind, int(at), _whole(until))
        if due:
            left = [r for r in rows if r[0] > now]
            self.waiting.put([self._wait(left)]) if left else self.waiting.clear()
        lapsed = state.state == "ignored" and state.ignored_until is not None and state.ignored_until <= now
        if not state.state or not due and before == (state.state, lapsed):
            return
        if due:
            self._wake_at_the_end(state)
        self._keep(state, lapsed, step + 1)
        yield Row(fingerprint=key[0], **asdict(state), lapsed=lapsed, step=step + 1)


def _with_moments(rows: DataFrame, change) -> DataFrame:
    return rows.select(*[change(c).alias(c) if c in _MOMENTS else F.col(c) for c in rows.columns])


def folded_stream(signals: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Changed states (``STEPS``) of a stream of signals (fingerprint, at, kind, until, seq) that come up to ``late`` late.

    ``initial`` has states (``STEPS``) to begin with, as a first stream or a batch left them.
    """
    signals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = signals.where("fingerprint is not null and at is not null").withWatermark("at", late)
    # the fold counts in microseconds
    timed = timed.select("fingerprint", "at", F.unix_micros("at").alias("moment"), "seq", "kind", F.unix_micros("until").alias("until"))
    begun = None if initial is None else _with_moments(initial, F.unix_micros).groupBy("fingerprint")
    steps = STEPS.replace(" timestamp", " long")
    return _with_moments(timed.groupBy("fingerprint").transformWithState(Fold(), steps, "update", "EventTime", begun), F.timestamp_micros)


def begun_with(states: DataFrame, now) -> DataFrame:
    """States of a batch fold as a stream's ``initial``."""
    lapsed = (F.col("state") == "ignored") & F.coalesce(F.col("ignored_until") <= now, F.lit(False))
    return states.withColumn("lapsed", lapsed).withColumn("step", F.lit(0).cast("long"))


class StateTable:
    """The newest state of each fingerprint, in buckets of a stored table.

    Writing the same rows again, as after a restart, changes nothing: of two rows
    the one of the later step stays.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table, self.buckets = Generations(spark, path, STEPS), buckets

    def read(self) -> DataFrame:
        return self.table.read().drop("part")

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in; only buckets that hold one of them are written."""
        bucket = F.pmod(F.crc32(F.col("fingerprint").cast("binary")), F.lit(self.buckets)).cast("int")
        new = rows.withColumn("part", bucket).persist()
        try:
            touched = [r["part"] for r in new.select("part").distinct().collect()]
            if touched:
                both = self.table.read(touched).unionByName(new.select(*self.table.read([]).columns))
                newest = both.groupBy("fingerprint").agg(F.max_by(F.struct(*both.columns), "step").alias("r")).select("r.*")
                self.table.commit([self.table.stage(newest, "fingerprint")], touched)
        finally:
            new.unpersist()

    def follow(self, states: DataFrame, checkpoint: str):
        """A query that writes a stream's states as they change, up to what is there now."""
        return states.writeStream.outputMode("update").foreachBatch(lambda batch, _: self.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")

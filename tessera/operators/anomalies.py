"""Anomalies: signals folded into one state for each fingerprint.

Signals (fingerprint, at, kind, until): signal, close, take, resolve, ignore,
reopen. A signal counts; it reopens what was resolved, or ignored until an
earlier moment; what is ignored without an end stays so. A close resolves what is
open or taken, by itself. The fold reads signals in order, one after another, so
that only a state is held for each fingerprint, never its list of signals.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "fingerprint string, state string, occurrences long, first_at timestamp, last_at timestamp, ignored_until timestamp, auto boolean, reopened long"


@dataclass
class State:
    state: str = ""
    occurrences: int = 0
    first_at: object = None
    last_at: object = None
    ignored_until: object = None
    auto: bool = False
    reopened: int = 0

    def apply(self, kind: str, at, until=None) -> None:
        if kind == "signal":
            if not self.state:
                self.state, self.first_at = "open", at
            elif self.state == "resolved" or self.state == "ignored" and self.ignored_until is not None and self.ignored_until < at:
                self.state, self.auto, self.reopened, self.ignored_until = "open", False, self.reopened + 1, None
            self.occurrences, self.last_at = self.occurrences + 1, at
        elif not self.state:
            return
        elif kind == "close":
            if self.state in ("open", "taken"):
                self.state, self.auto = "resolved", True
        elif kind == "take":
            self.state = "taken" if self.state == "open" else self.state
        elif kind == "resolve":
            self.state, self.auto = "resolved", False
        elif kind == "ignore":
            self.state, self.ignored_until = "ignored", until
        elif kind == "reopen":
            self.state, self.auto, self.ignored_until = "open", False, None


def folded(signals: DataFrame) -> DataFrame:
    """The state of each fingerprint after all its signals.

    Signals are dealt and sorted by fingerprint and time; a task reads them as a
    stream and holds one state, however many signals a fingerprint has.
    """

    def fold(batches):
        key, state = None, State()
        done: list[dict] = []
        for batch in batches:
            for f, at, kind, until in zip(batch["fingerprint"], batch["at"], batch["kind"], batch["until"], strict=True):
                if f != key:
                    if key is not None and state.state:
                        done.append({"fingerprint": key} | asdict(state))
                    key, state = f, State()
                state.apply(kind, at, None if pd.isna(until) else until)
            if len(done) > 5000:
                yield pd.DataFrame(done)
                done = []
        if key is not None and state.state:
            done.append({"fingerprint": key} | asdict(state))
        if done:
            yield pd.DataFrame(done)

    rows = signals.select("fingerprint", F.col("at").cast("timestamp").alias("at"), "kind", F.col("until").cast("timestamp").alias("until"), "seq").where("fingerprint is not null")
    return rows.repartition("fingerprint").sortWithinPartitions("fingerprint", "at", "seq").mapInPandas(fold, STATE)


def health_signals(events: DataFrame, key: str, at: str, down) -> DataFrame:
    """Level-triggered polls as signals: down signals, up closes."""
    return events.select(F.col(key).cast("string").alias("fingerprint"), F.col(at).alias("at"), F.when(down, "signal").otherwise("close").alias("kind"), F.lit(None).cast("timestamp").alias("until"), F.col("event_id").alias("seq"))


def stale(open_keys: DataFrame, produced: DataFrame) -> DataFrame:
    """Open fingerprints that a round no longer produces: to be closed."""
    return open_keys.join(produced, "fingerprint", "left_anti")


#: Days that a decision to ignore may hold; None is for ever. Fixed values.
IGNORED_DAYS = {"1d": 1, "7d": 7, "30d": 30, "always": None}


def judged(states: DataFrame, actions: DataFrame, companies: list[str]) -> DataFrame:
    """Manual actions with their ``outcome``: what they did, or why they are refused.

    ``states`` has fingerprint and company, ``actions`` seq, at, fingerprint, actor,
    action (take, assign, comment, resolve, ignore), text, target and ``until``. An
    anomaly of another company can't be told from one that doesn't exist.
    """
    seen = states.where(F.col("company").isNull() | F.col("company").isin(companies)).select("fingerprint", F.lit(True).alias("_seen"))
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    action = F.col("action")
    outcome = (
        F.when(F.col("_seen").isNull(), "refused: no such anomaly")
        .when(action == "take", "taken")
        .when(action == "assign", F.when(given("target"), "assigned").otherwise("refused: to whom?"))
        .when(action == "comment", F.when(given("text"), "commented").otherwise("refused: empty comment"))
        .when(action == "resolve", "resolved")
        .when(action == "ignore", F.when(~given("text"), "refused: a reason is needed").when(~F.coalesce(F.col("until").isin(list(IGNORED_DAYS)), F.lit(False)), "refused: until when?").otherwise("ignored"))
        .otherwise("refused: unknown action")
    )
    return actions.join(seen, "fingerprint", "left").withColumn("outcome", outcome).drop("_seen")


def acted(states: DataFrame, judged_actions: DataFrame) -> DataFrame:
    """``states`` (with state, assigned_to, ignored_until, auto) after the actions that were not refused.

    Each action sets its fields whatever they were, so that the last that sets a
    field decides: one aggregate by fingerprint. Comments set nothing.
    """
    a, o, seq = judged_actions, F.col("outcome"), F.col("seq")
    days = F.lit(None).cast("int")
    for name, n in IGNORED_DAYS.items():
        days = F.when(F.col("until") == name, F.lit(n).cast("int")).otherwise(days)
    state = F.when(o.isin("taken", "assigned"), "taken").when(o.isin("resolved", "ignored"), o)
    whose = F.when(o == "taken", F.col("actor")).when(o == "assigned", F.trim("target"))
    until = F.when(o == "ignored", F.col("at") + F.make_interval(days=days))
    last = a.groupBy("fingerprint").agg(
        F.max_by(state, F.when(state.isNotNull(), seq)).alias("_state"),
        F.max_by(whose, F.when(whose.isNotNull(), seq)).alias("_whose"),
        F.max_by(F.struct(until.alias("until")), F.when(o.isin("resolved", "ignored"), seq)).alias("_until"),
        F.coalesce(F.bool_or(o == "resolved"), F.lit(False)).alias("_by_hand"),
    )
    new = {
        "state": F.coalesce("_state", "state"),
        "assigned_to": F.coalesce("_whose", "assigned_to"),
        "ignored_until": F.when(F.col("_until").isNotNull(), F.col("_until.until")).otherwise(F.col("ignored_until")),
        "auto": F.when(F.coalesce(F.col("_by_hand"), F.lit(False)), F.lit(False)).otherwise(F.col("auto")),
    }
    both = states.join(last, "fingerprint", "left")
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in states.columns])


def log_of(judged_actions: DataFrame) -> DataFrame:
    """What was done, for the log: accepted actions; comments are events but no change."""
    done = judged_actions.where(~F.col("outcome").startswith("refused"))
    return done.select("at", "fingerprint", F.col("actor"), F.col("outcome").alias("event"), F.col("text"), (F.col("outcome") != "commented").alias("is_change"))

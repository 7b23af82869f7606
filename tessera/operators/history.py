"""Versioned tables (type 2 history): hashes, merges, current views, as-of joins and their checks.

A history has id, company, business columns, row_hash, valid_from, valid_to (null
while current) and deleted (a tombstone). Intervals are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.generations import Generations

VERSIONING = ("id", "company", "row_hash", "valid_from", "valid_to", "deleted")


def business_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c not in VERSIONING)


def canonical(columns: list[str]) -> Column:
    """Compact JSON of columns in sorted order; nulls are written, so that null and missing text differ."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the canonical business columns; id and company take no part."""
    return F.sha2(canonical(columns), 256)


def namespaced(company: Column, *ids: str) -> dict[str, Column]:
    """Company-prefixed keys, for an entity's id and for its references alike; an empty reference stays null."""
    return {c: F.when(F.col(c).isNotNull(), F.concat_ws(":", company, F.col(c).cast("string"))) for c in ids}


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in order; of equals the one whose values hash highest, so that reruns agree."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*rows.columns))))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def current(history: DataFrame) -> DataFrame:
    return history.where(F.col("valid_to").isNull() & ~F.col("deleted"))


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The versions that were valid at a moment."""
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (moment < F.col("valid_to"))) & ~F.col("deleted"))


def current_views(session: SparkSession, histories: dict[str, DataFrame], prefix: str = "current_") -> list[str]:
    """A view of the current rows of each history, without the columns of versioning; returns their names."""
    names = []
    for name, rows in histories.items():
        current(rows).drop("row_hash", "valid_from", "valid_to", "deleted").createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def merge(history: DataFrame, incoming: DataFrame, now: Column, full_load: bool) -> DataFrame:
    """The next history after a load of ``incoming`` (id, company, business columns; one row an id).

    Unchanged rows keep their version; changed ones close it and open another;
    new ids open one; on a full load ids that are missing close theirs and open a
    tombstone. An id that comes back after a tombstone closes that first. One
    full outer join of the open versions with the load; closed ones pass through.
    """
    columns = business_columns(incoming)
    closed, open_ = history.where("valid_to is not null"), history.where("valid_to is null")
    new = incoming.withColumn("new_hash", row_hash(columns)).select(F.col("id").alias("new_id"), F.col("company").alias("new_company"), "new_hash", *[F.col(c).alias(f"new_{c}") for c in columns])
    both = open_.join(new, open_["id"] == new["new_id"], "full")
    same = F.col("id").isNotNull() & F.col("new_id").isNotNull() & ~F.col("deleted") & (F.col("row_hash") == F.col("new_hash"))
    gone = F.col("new_id").isNull() & ~F.col("deleted") & F.lit(full_load)
    opens = F.col("new_id").isNotNull() & ~F.coalesce(same, F.lit(False))
    old = lambda to: F.struct(*[F.col(c) if c != "valid_to" else to.alias("valid_to") for c in history.columns])

    def version(values: dict[str, Column]) -> Column:
        return F.struct(*[values[c].cast(history.schema[c].dataType).alias(c) for c in history.columns])

    opened = version({c: F.col(f"new_{c}") for c in columns} | {"id": F.col("new_id"), "company": F.col("new_company"), "row_hash": F.col("new_hash"), "valid_from": now, "valid_to": F.lit(None), "deleted": F.lit(False)})
    tombstone = version({c: F.col(c) for c in (*columns, "id", "company", "row_hash")} | {"valid_from": now, "valid_to": F.lit(None), "deleted": F.lit(True)})
    rows = F.array_compact(
        F.array(
            F.when(F.col("id").isNotNull(), F.when(opens | gone, old(now)).otherwise(old(F.col("valid_to")))),
            F.when(opens, opened),
            F.when(gone, tombstone),
        )
    )
    return closed.unionByName(both.select(F.explode(rows).alias("v")).select("v.*"))


def broken_intervals(history: DataFrame) -> DataFrame:
    """Versions that overlap any before them, end before they begin, or leave an id with two open ones."""
    own = Window.partitionBy("id").orderBy("valid_from", F.col("valid_to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))).over(own)
    return history.where("true").withColumn("_before", before).where((F.col("_before") > F.col("valid_from")) | (F.col("valid_to") <= F.col("valid_from"))).drop("_before")


def is_collapsed(previous, rows):
    """A full load that shrank to less than half of what was there (two rows or more), for numbers and columns alike."""
    return (previous >= 2) & (rows < 0.5 * previous)


def fall(previous: Column, rows: Column) -> Column:
    """By how many percent a load shrank, rounded down."""
    return F.floor((1 - rows / previous) * 100)


def collapsed(previous: int, rows: int) -> bool:
    """Whether a full load is not to be merged."""
    return bool(is_collapsed(previous, rows))


#: Facts and versions of one key in one sorted run; more are cut by period.
HOT = 100_000


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, moment: str, how: str = "left", hot: int = HOT, period: str = "month") -> DataFrame:
    """Each fact with the version of its key that was valid at its moment.

    Versions of a key don't overlap (``broken_intervals`` finds those that do).
    Facts and versions are sorted together by key and time, once, and the last
    version is carried on to the facts behind it: nothing is multiplied. A key of
    more than ``hot`` facts is cut into periods, each of which begins with the
    version that was open then; facts of one key and one ``period`` are one run.
    """
    columns = [c for c in versions.columns if c != key]
    kind = versions.schema["valid_from"].dataType
    valid = versions.where(F.col(key).isNotNull() & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))))
    known = F.col(key).isNotNull() & F.col(moment).isNotNull()
    whole = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    version = F.struct(*[F.col(f"`{c}`") for c in columns])
    f = facts.where(known).select(F.col(key).alias("_key"), F.col(moment).cast(kind).alias("_at"), F.lit(1).alias("_kind"), whole.alias("_fact"), F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType).alias("_version"))
    v = valid.select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), version.alias("_version"))
    many = f.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("_key").alias("_many"))
    keys = [r["_many"] for r in many.limit(HOT + 1).collect()]
    if len(keys) > HOT:
        raise ValueError(f"more than {HOT} keys have over {hot} facts: raise hot")
    cut = F.when(F.col("_key").isin(keys), F.date_trunc(period, F.col("_at"))).otherwise(F.lit(None).cast("timestamp")) if keys else F.lit(None).cast("timestamp")
    rows = f.unionByName(v).withColumn("_period", cut)
    if keys:  # the version that is open where a period begins: one row a period and key
        own = v.where(F.col("_key").isin(keys)).withColumn("_period", cut)
        last = own.groupBy("_key", "_period").agg(F.max_by("_version", "_at").alias("_version"))
        begun = f.where(F.col("_key").isin(keys)).select("_key", cut.alias("_period")).distinct()
        both = begun.withColumn("_asked", F.lit(True)).join(last, ["_key", "_period"], "full")
        before = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        opening = both.withColumn("_version", F.last("_version", ignorenulls=True).over(before)).where("_asked and _version is not null")
        rows = rows.unionByName(opening.select("_key", F.col("_version.valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), "_version", "_period"))
    along = Window.partitionBy("_key", "_period").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("_version", F.last("_version", ignorenulls=True).over(along)).where("_kind = 1")
    open_ = F.col("_version.valid_to").isNull() | (F.col("_at") < F.col("_version.valid_to"))
    if how == "inner":
        carried = carried.where(F.col("_version").isNotNull() & open_)
    out = carried.select("_fact.*", *[F.when(open_, F.col(f"_version.`{c}`")).alias(c) for c in columns])
    if how == "left":
        out = out.unionByName(facts.where(~known).select("*", *[F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in columns]))
    return out


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Status rows after an update: new values where given, else the old ones."""
    columns = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = old.join(n, F.col(key) == F.col("_key"), "full")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def nonconforming(schema_columns: set[str], canonical_columns: set[str], reserved: set[str]) -> list[str]:
    """Columns that a connector may not emit: unknown ones and reserved personal ones."""
    return sorted((schema_columns - canonical_columns) | (schema_columns & reserved))


def unstable(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that are in one of two extractions only."""
    a, b = first.select(key), second.select(key)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def due(catalogue: DataFrame, status: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """Entities whose last run is their frequency ago or more; never run counts as due, disabled as never."""
    rows = catalogue.join(status, ["company", "entity"], "left").join(overrides, ["company", "entity"], "left")
    every = F.coalesce("every_minutes", "default_minutes")
    passed = (F.unix_timestamp(now) - F.unix_timestamp(F.col("last_run").cast("timestamp"))) / 60
    return rows.where(F.coalesce("enabled", F.lit(True)) & (F.col("last_run").isNull() | (passed >= every))).select("company", "entity", every.alias("every_minutes"))


def prepared(incoming: DataFrame, references: list[str], order: str) -> DataFrame:
    """A load's rows with an id, the last of each, keys and references prefixed by the company."""
    keys = namespaced(F.col("company"), "id", *references)
    rows = last_wins(incoming.where("id is not null"), "id", order).drop(order)
    return rows.select(*[keys[c].alias(c) if c in keys else F.col(c) for c in rows.columns])


def collapse_reason(before: int, rows: int) -> str:
    return f"collapsed by {int((1 - rows / before) * 100)} %"


def load(current_history: DataFrame, incoming: DataFrame, references: list[str], order: str, now: Column, full_load: bool) -> tuple[DataFrame | None, str]:
    """A whole load: keys prefixed, last row of an id kept, size checked, merged.

    Returns the next history and 'ok', or None and the reason if the load is
    blocked; the caller writes the history in one go, so a failure changes nothing.
    """
    rows = prepared(incoming, references, order)
    if full_load:
        before, now_rows = current(current_history).count(), rows.count()
        if collapsed(before, now_rows):
            return None, collapse_reason(before, now_rows)
    return merge(current_history, rows, now, full_load), "ok"


BUCKETS = 64


class StoredHistory:
    """A history in a folder: open versions in buckets of the id, closed ones in buckets of their own.

    A load reads and rewrites the open buckets its ids fall in (all on a full load,
    which has to notice what is missing) and adds what it closed to the others; old
    closed versions are not touched. Both are seen at once or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = BUCKETS):
        kinds = f"id string, company string, {columns}, row_hash string, valid_from timestamp_ntz, valid_to timestamp_ntz, deleted boolean"
        self.table, self.buckets = Generations(spark, path, kinds), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(self.buckets)).cast("int")

    def open_versions(self, buckets=None) -> DataFrame:
        return self.table.read(range(self.buckets) if buckets is None else buckets).drop("part")

    def current(self) -> DataFrame:
        """Open versions that aren't tombstones: closed ones are not read."""
        return current(self.open_versions())

    def versions(self) -> DataFrame:
        """All versions."""
        return self.table.read().drop("part")

    def as_of(self, moment: Column) -> DataFrame:
        return as_of(self.versions(), moment)

    def of_ids(self, ids: list[str]) -> DataFrame:
        """All versions of some ids, from their buckets only."""
        import zlib

        at = {zlib.crc32(i.encode()) % self.buckets for i in ids}
        return self.table.read(at | {b + self.buckets for b in at}).where(F.col("id").isin(ids)).drop("part")

    def load(self, incoming: DataFrame, references: list[str], order: str, now: Column, full_load: bool) -> str:
        """``load`` on what is stored: 'ok', or why nothing was changed."""
        rows = prepared(incoming, references, order).withColumn("part", self._bucket())
        # written once, so that what is counted, compared and merged is the same
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "part")
        inbox = Generations(self.table.spark, f"{self.table.path}/incoming", kinds)
        rows = inbox.staged(inbox.stage(rows))
        if full_load:
            before, now_rows = self.current().count(), rows.count()
            if collapsed(before, now_rows):
                return collapse_reason(before, now_rows)
            touched = list(range(self.buckets))
        else:
            touched = [r["part"] for r in rows.select("part").distinct().collect()]
        self.switch(self.staged(rows.drop("part"), touched, now, full_load), touched)
        return "ok"

    def staged(self, rows: DataFrame, touched: list[int], now: Column, full_load: bool) -> str:
        """The load's open and newly closed versions, written where no reader looks yet."""
        after = merge(self.open_versions(touched), rows, now, full_load)
        part = F.when(F.col("valid_to").isNull(), self._bucket()).otherwise(self._bucket() + self.buckets)
        return self.table.stage(after.withColumn("part", part), "id")

    def switch(self, load: str, touched: list[int]) -> None:
        """From now on readers see the load."""
        self.table.commit([load], touched)

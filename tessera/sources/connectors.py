"""Business systems as sources: JDBC views and connectors that are Spark formats, read in partitions and by a high-water mark."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, InputPartition, IsNotNull, LessThanOrEqual


def jdbc_rows(spark: SparkSession, url: str, table: str, company: str, since: str | None = None, modified: str = "modified_at", key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A view of a business system; rows changed since the mark, in parallel over a numeric key if its bounds are known."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return extracted(reader.load(), company, since, modified)


def extracted(rows: DataFrame, company: str, since: str | None = None, modified: str = "modified_at") -> DataFrame:
    """Rows of a company after the mark; rows without a time of change are read each time."""
    if since is not None and modified in rows.columns:
        rows = rows.where(F.col(modified).isNull() | (F.col(modified) > F.lit(since).cast("timestamp")))
    return rows.withColumn("company", F.lit(company))


def high_water(rows: DataFrame, modified: str = "modified_at") -> DataFrame:
    """The next mark of each company; none where nothing was read."""
    return rows.groupBy("company").agg(F.max(modified).alias("mark"))


class Connector:
    """A business system that rows are pulled from. Instances travel to the executors.

    ``modified`` is the column of the last change. Rows without one are read by
    every pull and by no stream.
    """

    name = "connector"
    modified = "modified_at"

    def entities(self) -> dict[str, str]:
        """Schema (DDL) of each entity."""
        raise NotImplementedError

    def partitions(self, entity: str) -> list:
        """What tasks read side by side; each value is given to ``rows``."""
        return [None]

    def rows(self, entity: str, partition, since: dt.datetime | None, until: dt.datetime | None) -> Iterator:
        """Tuples or Arrow batches changed after ``since`` and not after ``until``, where given."""
        raise NotImplementedError

    def mark(self, entity: str) -> dt.datetime | None:
        """Time of the newest change; None where there is none."""
        raise NotImplementedError


class MemoryConnector(Connector):
    """Tables held in memory: entity to (schema, tuples)."""

    def __init__(self, name: str, tables: dict[str, tuple[str, list[tuple]]], modified: str = "modified_at", parts: int = 2):
        self.name, self.tables, self.modified, self.parts = name, tables, modified, parts

    def _at(self, entity: str) -> int:
        names = [c.split()[0] for c in self.tables[entity][0].split(",")]
        return names.index(self.modified) if self.modified in names else -1

    def entities(self) -> dict[str, str]:
        return {entity: kinds for entity, (kinds, _) in self.tables.items()}

    def partitions(self, entity: str) -> list:
        return list(range(self.parts))

    def rows(self, entity, partition, since, until):
        at = self._at(entity)
        for row in self.tables[entity][1][partition :: self.parts]:
            changed = row[at] if at >= 0 else None
            if changed is None or (since is None or changed > since) and (until is None or changed <= until):
                yield row

    def mark(self, entity):
        at = self._at(entity)
        return max((r[at] for r in self.tables[entity][1] if at >= 0 and r[at] is not None), default=None)


class ParquetConnector(Connector):
    """Exports of a system: a Parquet file or folder for each entity, read by row groups, each filtered as it is read."""

    def __init__(self, name: str, entities: dict[str, tuple[str, str]], modified: str = "modified_at", until: dt.datetime | None = None):
        self.name, self.files, self.modified, self.until = name, entities, modified, until

    def entities(self) -> dict[str, str]:
        return {entity: kinds for entity, (kinds, _) in self.files.items()}

    def _fragments(self, entity: str):
        import pyarrow.dataset as ds

        return [part for f in ds.dataset(self.files[entity][1]).get_fragments() for part in f.split_by_row_group()]

    def partitions(self, entity: str) -> list:
        return list(range(len(self._fragments(entity))))

    def _filter(self, since, until):
        import pyarrow.compute as pc

        until = min((x for x in (until, self.until) if x is not None), default=None)
        kept = pc.scalar(True)
        if since is not None:
            kept = kept & (pc.field(self.modified) > since)
        if until is not None:
            kept = kept & (pc.field(self.modified) <= until)
        return kept | pc.field(self.modified).is_null()

    def rows(self, entity, partition, since, until):
        names = [c.split()[0] for c in self.files[entity][0].split(",")]
        yield from self._fragments(entity)[partition].to_batches(columns=names, filter=self._filter(since, until))

    def mark(self, entity):
        import pyarrow.compute as pc

        newest = (pc.max(b.column(0)).as_py() for f in self._fragments(entity) for b in f.to_batches(columns=[self.modified], filter=self._filter(None, None)))
        return max((x for x in newest if x is not None), default=None)


def _time(value) -> dt.datetime | None:
    return None if value in (None, "") else dt.datetime.fromisoformat(str(value))


class _Part(InputPartition):
    def __init__(self, partition, since: dt.datetime | None, until: dt.datetime | None, timed: bool = False):
        self.partition, self.since, self.until, self.timed = partition, since, until, timed


class _Rows:
    """Rows of a part, in the order of the schema that Spark asked for."""

    def __init__(self, connector: Connector, entity: str, schema):
        self.connector, self.entity, self.schema = connector, entity, schema

    def read(self, part: _Part):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, at = to_arrow_schema(self.schema), self.schema.names.index(self.connector.modified) if self.connector.modified in self.schema.names else -1
        for rows in self.connector.rows(self.entity, part.partition, part.since, part.until):
            if isinstance(rows, pa.RecordBatch):
                if part.timed:
                    rows = rows.filter(rows.column(at).is_valid())
                yield pa.RecordBatch.from_arrays([rows.column(n).cast(kinds.field(n).type) for n in kinds.names], schema=kinds)
            elif not (part.timed and rows[at] is None):
                yield rows


class _Batch(_Rows, DataSourceReader):
    """Reads rows changed after the mark; a filter on the time of change moves into the connector."""

    def __init__(self, connector, entity, schema, since):
        super().__init__(connector, entity, schema)
        self.since, self.until, self.timed = since, None, False

    def pushFilters(self, filters):
        for f in filters:
            of_change = getattr(f, "attribute", None) == (self.connector.modified,)
            if of_change and isinstance(f, GreaterThan):
                self.since, self.timed = max(f.value, self.since or f.value), True
            elif of_change and isinstance(f, LessThanOrEqual):
                self.until, self.timed = min(f.value, self.until or f.value), True
            elif of_change and isinstance(f, IsNotNull):
                self.timed = True
            else:
                yield f

    def partitions(self):
        return [_Part(p, self.since, self.until, self.timed) for p in self.connector.partitions(self.entity)]


class _Stream(_Rows, DataSourceStreamReader):
    """Offsets are marks: a batch holds what changed after one and up to the next, so that a restart goes on behind the last."""

    def initialOffset(self) -> dict:
        return {"mark": ""}

    def latestOffset(self) -> dict:
        found = self.connector.mark(self.entity)
        return {"mark": "" if found is None else found.isoformat()}

    def partitions(self, start: dict, end: dict):
        if not end["mark"] or start["mark"] >= end["mark"]:
            return []
        return [_Part(p, _time(start["mark"]), _time(end["mark"]), True) for p in self.connector.partitions(self.entity)]


def registered(spark: SparkSession, connector: Connector) -> str:
    """Make a connector a format of the session; returns the format's name.

    ``spark.read.format(name).option("entity", ...)``, with ``since`` (a time) if
    wanted, reads in the connector's partitions; ``readStream`` reads changes.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return connector.name

        def _entity(self) -> str:
            entity = self.options.get("entity", "")
            if entity not in connector.entities():
                raise ValueError(f"unknown entity {entity!r} of {connector.name}")
            return entity

        def schema(self) -> str:
            return connector.entities()[self._entity()]

        def reader(self, schema) -> DataSourceReader:
            return _Batch(connector, self._entity(), schema, _time(self.options.get("since")))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(connector, self._entity(), schema)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return connector.name


def pulled(spark: SparkSession, connector: Connector, entity: str, company: str, since: str | None = None) -> DataFrame:
    """A company's rows of an entity, changed after the mark."""
    reader = spark.read.format(registered(spark, connector)).option("entity", entity)
    return (reader if since is None else reader.option("since", since)).load().withColumn("company", F.lit(company))


def changes_into(spark: SparkSession, connector: Connector, entity: str, path: str, checkpoint: str) -> None:
    """Append an entity's changes since the last call to a Parquet folder, each row once whatever fails in between."""
    rows = spark.readStream.format(registered(spark, connector)).option("entity", entity).load()
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

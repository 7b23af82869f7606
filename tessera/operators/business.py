"""Business records: canonical views, pivots, metrics over versioned dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(value: Column) -> Column:
    """Booleans as different systems write them."""
    return F.coalesce(value.isin("S", "1", "true", "V"), F.lit(False))


def empty_as_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def discounted(price: Column, discounts: Column) -> Column:
    """Cascading discounts in percent; missing ones are left out."""
    return F.aggregate(F.array_compact(discounts), price, lambda p, d: p * (1 - d / 100))


def code_table(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Several (code, description) tables as one with their kind."""
    out = None
    for kind, rows in tables:
        part = rows.select(F.lit(kind).alias("kind"), "code", "description")
        out = part if out is None else out.unionByName(part)
    return out


def pivoted(attributes: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Attribute rows (key, name, value) as columns, in one aggregation."""
    return attributes.groupBy(*keys).pivot("name", names).agg(F.min("value"))


def unpivoted(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Columns as (kind, value) rows, without empty ones."""
    return rows.unpivot(ids, columns, "kind", "value").where("coalesce(value, '') <> ''")


def monthly(rows: DataFrame, moment: str, **measures: Column) -> DataFrame:
    return rows.groupBy(F.date_format(F.date_trunc("month", F.col(moment)), "yyyy-MM").alias("month")).agg(*[m.alias(n) for n, m in measures.items()])


def referential_gaps(rows: DataFrame, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent: a check, not a constraint."""
    return rows.where(F.col(reference).isNotNull()).join(parents.select(F.col(key).alias(reference)), reference, "left_anti")


def with_role(subjects: DataFrame, roles: DataFrame, key: str, kind: str, role_columns: list[str]) -> DataFrame:
    """Subjects in use with each role of a kind that is in use: an inner join on ``key``.

    Both have ``obsolete``; roles have ``kind``. Columns of the role follow the subject's.
    """
    held = roles.where((F.col("kind") == kind) & ~F.col("obsolete")).select(F.col(key).alias("_key"), *role_columns)
    return subjects.where(~F.col("obsolete") & F.col(key).isNotNull()).drop("obsolete").join(held, F.col(key) == F.col("_key")).drop("_key")


def with_subject(addresses: DataFrame, subjects: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Addresses in use with their subject in use; addresses of nobody are left out."""
    held = subjects.where(~F.col("obsolete")).select(F.col(key).alias("_key"), *columns)
    return addresses.where(~F.col("obsolete") & F.col(key).isNotNull()).drop("obsolete").join(held, F.col(key) == F.col("_key")).drop("_key")


def with_connection(companies: DataFrame, connections: DataFrame) -> DataFrame:
    """Active companies with the name of their connection, if they have one."""
    c = connections.select(F.col("id").alias("connection"), F.col("name").alias("connection_name"))
    return companies.where("active").join(c, "connection", "left").select("code", "name", "connection", "connection_name")


def to_import(companies: DataFrame, connections: DataFrame) -> DataFrame:
    """Active companies whose connection is active and has its secrets."""
    c = connections.where("active and secrets is not null").select(F.col("id").alias("connection"), "kind")
    return companies.where("active").join(c, "connection").select("code", "connection", "kind")


def synchronised(runs: DataFrame, companies: DataFrame, mine: list[str]) -> DataFrame:
    """Import runs of the reader's companies with the company's name."""
    return runs.where(F.col("company").isin(mine)).join(companies.select(F.col("code").alias("company"), "name"), "company")


def connection_lists(connections: DataFrame, companies: DataFrame) -> DataFrame:
    """Each connection with the list of its companies (code, name), in order; empty where it has none."""
    lists = companies.where("connection is not null").groupBy(F.col("connection").alias("id")).agg(F.array_sort(F.collect_list(F.struct("code", "name"))).alias("companies"))
    none = F.array().cast(lists.schema["companies"].dataType)
    return connections.join(lists, "id", "left").withColumn("companies", F.coalesce("companies", none))

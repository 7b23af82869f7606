"""Access control as data: who may read which source, in every plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY_PREFIX = "company-"


def companies_of(groups: list[str]) -> list[str]:
    """Companies named by groups with the company prefix, each once, sorted."""
    return sorted({g[len(COMPANY_PREFIX) :] for g in groups if g.startswith(COMPANY_PREFIX)})


def companies_column(groups: Column) -> Column:
    """``companies_of`` for an array column."""
    named = F.filter(groups, lambda g: g.startswith(COMPANY_PREFIX))
    return F.array_sort(F.array_distinct(F.transform(named, lambda g: F.substring(g, len(COMPANY_PREFIX) + 1, 1000))))


@dataclass(frozen=True)
class Principal:
    """A reader: groups decide who may read, companies what belongs to them."""

    groups: tuple[str, ...]
    companies: tuple[str, ...]

    @staticmethod
    def of(groups: list[str]) -> Principal:
        return Principal(tuple(groups), tuple(companies_of(groups)))


def overlaps(a: Column, b: Column) -> Column:
    """Arrays share an element; false, not null, where one holds nulls or is null."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def allowed_sources(sources: DataFrame, who: Principal) -> DataFrame:
    """Active sources that share a group and a company with the reader; none for a reader without either."""
    if not who.groups or not who.companies:
        return sources.where(F.lit(False))
    return sources.where(overlaps(F.col("acl_groups"), literals(who.groups)) & overlaps(F.col("companies"), literals(who.companies)) & (F.col("state") == "active"))


def secured(rows: DataFrame, sources: DataFrame, who: Principal, key: str = "source_id") -> DataFrame:
    """Rows of allowed sources. The filter is in the plan below any limit, so ranks count visible rows only."""
    return rows.join(allowed_sources(sources, who).select(F.col("id").alias(key)), key, "left_semi")


def secure_session(spark: SparkSession, tables: dict[str, Callable[[SparkSession], DataFrame]], sources: Callable[[SparkSession], DataFrame], who: Principal) -> SparkSession:
    """A session of the reader's own, with temporary views of ``tables`` that hold what they may see.

    Each table is made by a function of the session it is read in. Another
    reader's session has views of its own under the same names.
    """
    own = spark.newSession()
    for name, make in tables.items():
        secured(make(own), sources(own), who).createOrReplaceTempView(name)
    return own


def of_companies(listed: Column, mine: list[str]) -> Column:
    """Rows whose text list of companies names one of the reader's."""
    return overlaps(F.split(listed, ","), literals(mine))


def administered(company: Column, area: Column, mine: list[str], areas: list[str]) -> Column:
    """Rows of an administrator: without company or of one of theirs, in their areas."""
    return (company.isNull() | company.isin(mine)) & area.isin(areas)


def explained(users: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each user sees each source, and the first rule that says no.

    Users and sources are configuration, so that their product is a stated report.
    """
    pairs = users.select("user", "enabled", "groups", "user_companies").join(sources, F.lit(True))
    reason = (
        F.when(~F.col("enabled"), "user disabled")
        .when(F.col("state") != "active", F.concat(F.lit("source "), F.col("state")))
        .when(~overlaps(F.col("acl_groups"), F.col("groups")), "no common group")
        .when(~overlaps(F.col("companies"), F.col("user_companies")), "no common company")
        .otherwise("visible")
    )
    return pairs.select("user", F.col("id").alias("source_id"), reason.alias("reason"), (reason == "visible").alias("sees"))


def permissions(roles: DataFrame, matrix: DataFrame, all_companies: Column) -> DataFrame:
    """Union of the areas of a user's roles: write wins over read; areas tied to companies need all of them."""
    held = roles.select("user", "has_all", F.explode("roles").alias("role")).join(matrix, "role")
    held = held.where(~F.col("restricted") | all_companies)
    return held.groupBy("user", "area").agg(F.max(F.when(F.col("level") == "M", 2).otherwise(1)).alias("rank")).select("user", "area", F.when(F.col("rank") == 2, "M").otherwise("L").alias("level"))


def editable(sources: DataFrame, mine: list[str]) -> DataFrame:
    """Sources an administrator sees (a common company, or none set), and whether all their companies are theirs."""
    own = literals(mine)
    seen = sources.where(overlaps(F.col("companies"), own) | (F.size("companies") == 0))
    return seen.withColumn("editable", F.size(F.array_except("companies", own)) == 0)

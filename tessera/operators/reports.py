"""Operational reports: dashboards, heartbeats, worst-of, taint, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_dashboard(sources: DataFrame, chunks: DataFrame, updated: str) -> DataFrame:
    """Documents, pages (a null page counts) and last update of each source: one aggregate and one join."""
    per = chunks.groupBy("source_id").agg(F.countDistinct("document").alias("n_documents"), F.countDistinct(F.struct("document", "page")).alias("n_pages"), F.count(F.lit(1)).alias("n_chunks"), F.max(updated).alias("last_update"))
    return sources.select(F.col("id").alias("source_id"), "state").join(per, "source_id", "left").na.fill(0, ["n_documents", "n_pages", "n_chunks"])


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last row of each key, by one aggregate."""
    best = F.max_by(F.struct(*columns), F.col(order)).alias("last")
    return rows.groupBy(key).agg(F.max(order).alias(order), best).select(key, order, "last.*")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n last rows of each key; the rank filter lets a task keep n rows of a key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("nth") <= n)


def worst_of(rows: DataFrame, key: str, down: Column, up: Column) -> DataFrame:
    """critical if anything is down, attention if anything isn't up, else ok."""
    return rows.groupBy(key).agg(F.max(down.cast("int")).alias("d"), F.min(up.cast("int")).alias("u")).select(key, F.when(F.col("d") == 1, "critical").when(F.col("u") == 0, "attention").otherwise("ok").alias("light"))


def tainted(turns: DataFrame, internal: Column) -> DataFrame:
    """Once a conversation has used an internal source, its later turns stay tainted."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("tainted", F.max(internal).over(w))


def within_budget(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of each key until their texts exceed the budget, one at least; ``resume`` is where to go on after the last of them, null at the end."""
    w = Window.partitionBy(key).orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("total", total).withColumn("nth", F.row_number().over(w)).withColumn("_next", F.lead(order).over(w))
    kept = marked.where((F.col("total") <= budget) | (F.col("nth") == 1))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("nth"))) == 1
    return kept.withColumn("resume", F.when(last, F.col("_next"))).drop("_next")


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: key, run, value, size."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key, "run", value).agg(F.count(F.lit(1)).alias("size"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in and out of each node, 0 for lone ones."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "node", "left").na.fill(0, ["degree"])


def majority(votes: DataFrame, key: str, vote: str, valid: list[str]) -> DataFrame:
    """The most frequent valid vote of each key; ties go to the first in the alphabet."""
    counts = votes.where(F.col(vote).isin(valid)).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by(F.struct(F.col(vote).alias("vote"), "n"), F.struct(F.col("n"), -F.ascii(vote))).alias("best")).select(key, "best.vote", "best.n")


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Names of the fields that differ, nulls as values; rows without a difference are left out."""
    b = before.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = after.join(b, F.col(key) == F.col("_key"))
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return both.select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")


def totals(relations: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several relations in one row: counts are unioned and pivoted by one aggregate."""
    rows = None
    for name, relation in relations.items():
        part = relation.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in relations])


def source_states(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Indexed documents, those with an error, and the last update of each source; sources without documents have zeros."""
    per = documents.groupBy("source_id").agg(F.count_if(F.col("state") == "indexed").alias("n_indexed"), F.count_if(F.col("state") == "error").alias("n_errors"), F.max("updated_at").alias("last_update"))
    return sources.select(F.col("id").alias("source_id")).join(per, "source_id", "left").na.fill(0, ["n_indexed", "n_errors"])


def edge_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edges of each relation lead from one kind of node to another; an unnamed kind is '?', and edges need both nodes."""
    end = lambda side: nodes.select(F.col("node").alias(side), F.coalesce("kind", F.lit("?")).alias(f"{side}_kind"))
    both = edges.join(end("src"), "src").join(end("dst"), "dst")
    return both.groupBy("src_kind", F.coalesce("relation", F.lit("")).alias("relation"), "dst_kind").agg(F.count(F.lit(1)).alias("n"))

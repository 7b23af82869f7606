"""Files in and out: folder scans, whole texts, exports, snapshots, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import readable_files


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Readable files of a folder tree: path, size, mtime, content hash, ext, reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_replace("path", r"^.*?" + folder.strip("/").replace(".", r"\.") + "/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))
    return readable_files(rows)


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of plain text files."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """connector, entity and strategy from the manifest.json of each connector's folder."""
    rows = spark.read.schema("connector string, entities map<string, struct<strategy: string, tables: array<string>>>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(folder)
    return rows.select("connector", F.explode("entities").alias("entity", "e")).select("connector", "entity", "e.strategy", "e.tables")


def export_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a header that begins with a byte-order mark, so that spreadsheets read UTF-8, and structures as JSON."""
    flat = rows.select(*[F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c) for c in rows.columns])
    flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    flat.write.mode("errorifexists").option("sep", ";").option("header", "true").csv(path)


def chunks_under_headings(rows: DataFrame) -> DataFrame:
    """Chunks of a layout reader (headings array, text, pages array) as pieces: the headings' path, then the text, on the first page."""
    path = F.array_join(F.filter("headings", lambda h: F.trim(h) != ""), " > ")
    return rows.withColumn("piece", F.concat_ws("\n", F.when(path != "", path), F.col("text"))).withColumn("page", F.get("pages", 0)).drop("headings", "text", "pages")


def write_snapshot(rows: DataFrame, path: str, day: str = "day") -> None:
    """Replace the days that ``rows`` holds, and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only: there is no writer that changes or removes rows of a log."""
    rows.write.mode("append").parquet(path)


def replace_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks with those of re-read documents replaced, without repeats."""
    fresh = incoming.select("source_id", "document").distinct()
    kept = stored.join(fresh, ["source_id", "document"], "left_anti")
    return kept.unionByName(incoming.dropDuplicates(["source_id", "document", "page", "content"]))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export of ``export_csv`` as texts, its byte-order mark taken off the first name."""
    rows = spark.read.option("sep", ";").option("header", "true").option("quote", '"').option("escape", "\\").csv(path)
    return rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))

"""Relations that the queries share, derived from the given tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.acl import Principal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GROUPS = ["all", "sales", "company-acme"]
WHO = Principal.of(GROUPS)
TERMS = "trash pathetic worthless the"

# SQL of the relations below, for WITH
SOURCES = """sources AS (SELECT id, CASE n % 4 WHEN 0 THEN ['all'] WHEN 1 THEN ['sales', 'board'] WHEN 2 THEN ['tech'] ELSE ['all', 'tech'] END AS acl_groups,
 CASE n % 3 WHEN 0 THEN ['acme'] WHEN 1 THEN ['borea'] ELSE ['acme', 'borea'] END AS companies,
 CASE WHEN n % 7 = 6 THEN 'suspended' ELSE 'active' END AS state, CASE WHEN n % 5 = 0 THEN 'internal' ELSE 'cloud' END AS residency, 'root/' || (n % 4) || '/' || id AS path
 FROM (SELECT DISTINCT source AS id, coalesce(TRY_CAST(substr(source, 4) AS INTEGER), 0) AS n FROM documents WHERE source IS NOT NULL))"""
ALLOWED = """allowed AS (SELECT id FROM sources WHERE list_has_any(acl_groups, ['all', 'sales', 'company-acme']) AND list_has_any(companies, ['acme']) AND state = 'active')"""
CHUNKS = """chunks AS (SELECT doc_id AS id, source AS source_id, 'doc' || CAST(doc_id // 10 AS VARCHAR) AS document,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 10 AS INTEGER) END AS page, coalesce(text, '') AS content, lang FROM documents)"""
FIGURES = """figures AS (SELECT e.vec_id AS id, c.source_id, c.document, c.page, c.content AS description, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label
 FROM embeddings e JOIN chunks c ON c.id = e.vec_id)"""
VECTORS = """vectors AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.id)"""
QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
PRICES = """prices AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderdate AS valid_from,
 lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def query(sql: str | None = None, *relations: str):
    """Register a query under its function's name, with the SQL that checks it (``relations`` as WITH)."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = (f"WITH {', '.join(relations)}\n" if relations else "") + sql
        return function

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[str], None]) -> str:
    """The folder of something that queries of a session share, such as an index: ``build`` makes it once."""
    import uuid

    from tessera.sources.generations import work_dir

    key = f"tessera.stored.{name}.{folder}"
    path = spark.conf.get(key, None)
    if path is None:
        path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build(path)
        spark.conf.set(key, path)
    return path


def postings(spark: SparkSession, folder: str):
    """Stored words of all passages."""
    from tessera.operators.postings import Postings

    return Postings(spark, stored(spark, folder, "postings", lambda path: Postings(spark, path).update(None, chunks(spark, folder))))


def literals(spark: SparkSession, folder: str):
    """Stored groups of three letters of all passages."""
    from tessera.operators.postings import Literals

    return Literals(spark, stored(spark, folder, "literals", lambda path: Literals(spark, path).update(None, chunks(spark, folder))))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Registry of sources with groups, companies, state and residency."""
    n = F.coalesce(F.expr("try_cast(substring(id, 4) as int)"), F.lit(0))
    ids = read(spark, folder, "documents").where("source is not null").select(F.col("source").alias("id")).distinct()
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    return ids.select(
        "id",
        F.when(n % 4 == 0, arr("all")).when(n % 4 == 1, arr("sales", "board")).when(n % 4 == 2, arr("tech")).otherwise(arr("all", "tech")).alias("acl_groups"),
        F.when(n % 3 == 0, arr("acme")).when(n % 3 == 1, arr("borea")).otherwise(arr("acme", "borea")).alias("companies"),
        F.when(n % 7 == 6, "suspended").otherwise("active").alias("state"),
        F.when(n % 5 == 0, "internal").otherwise("cloud").alias("residency"),
        F.concat(F.lit("root/"), (n % 4).cast("string"), F.lit("/"), F.col("id")).alias("path"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as passages of larger documents, some without a page."""
    d = F.col("doc_id")
    page = F.when(d % 11 != 0, (d % 10).cast("int"))
    return read(spark, folder, "documents").select(d.alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("doc"), F.floor(d / 10).cast("string")).alias("document"), page.alias("page"), F.coalesce("text", F.lit("")).alias("content"), "lang")


def with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that have a vector."""
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return chunks(spark, folder).join(e, "id")


def figures(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return chunks(spark, folder).join(e, "id").select("id", "source_id", "document", "page", F.col("content").alias("description"), "embedding", "label")


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    return [float(x) for x in read(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"]]


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as versions of a customer: valid until the next order."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))

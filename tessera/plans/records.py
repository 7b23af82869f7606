"""Queries on business joins, connections, sources, graphs and what is written out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import business, history, ingest, reports
from tessera.sources import files
from tessera.sources.generations import work_dir

from .base import CHUNKS, SOURCES, chunks, figures, query, read, sources

SUBJECTS = """subjects AS (SELECT c_custkey AS id, c_name AS name, c_acctbal < -900 AS obsolete FROM customer),
roles AS (SELECT DISTINCT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'C' ELSE o_orderstatus END AS kind, o_orderpriority AS payment, o_orderpriority LIKE '5%' AS obsolete FROM orders)"""


def _subjects(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < -900).alias("obsolete"))


@query("SELECT s.id, s.name, r.payment FROM subjects s JOIN roles r ON r.id = s.id AND r.kind = 'C' AND NOT r.obsolete WHERE NOT s.obsolete", SUBJECTS)
def subjects_of_a_role(spark, d):
    """Subjects in use with each of their roles of a kind."""
    kind = F.when(F.col("o_orderstatus") == "F", "C").otherwise(F.col("o_orderstatus"))
    roles = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("payment"), F.col("o_orderpriority").startswith("5").alias("obsolete")).distinct()
    return business.with_role(_subjects(spark, d), roles, "id", "C", ["payment"]).select("id", "name", "payment")


@query("SELECT o_orderkey AS address, s.id, s.name FROM orders JOIN subjects s ON s.id = o_custkey AND NOT s.obsolete WHERE o_orderstatus <> 'P'", SUBJECTS)
def addresses_of_subjects(spark, d):
    """Addresses in use with their subject."""
    addresses = read(spark, d, "orders").select(F.col("o_orderkey").alias("address"), F.col("o_custkey").alias("id"), (F.col("o_orderstatus") == "P").alias("obsolete"))
    return business.with_subject(addresses, _subjects(spark, d), "id", ["name"]).select("address", "id", "name")


CONNECTIONS = """connections AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 2 AS active, CASE WHEN n_nationkey % 4 <> 0 THEN 'x' END AS secrets, 'kind' || n_regionkey AS kind FROM nation),
companies AS (SELECT s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS connection, s_acctbal > 0 AS active FROM supplier)"""


def _connections(spark, d):
    k = F.col("n_nationkey")
    connections = read(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 2).alias("active"), F.when(k % 4 != 0, "x").alias("secrets"), F.concat(F.lit("kind"), F.col("n_regionkey").cast("string")).alias("kind"))
    companies = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_nationkey")).alias("connection"), (F.col("s_acctbal") > 0).alias("active"))
    return connections, companies


@query("SELECT a.code, a.name, a.connection, c.name AS connection_name FROM companies a LEFT JOIN connections c ON c.id = a.connection WHERE a.active", CONNECTIONS)
def companies_with_connection(spark, d):
    """Active companies with their connection, if any."""
    connections, companies = _connections(spark, d)
    return business.with_connection(companies, connections)


@query("SELECT a.code, a.connection, c.kind FROM companies a JOIN connections c ON c.id = a.connection WHERE a.active AND c.active AND c.secrets IS NOT NULL", CONNECTIONS)
def companies_to_import(spark, d):
    """Active companies whose connection can be used."""
    connections, companies = _connections(spark, d)
    return business.to_import(companies, connections)


@query("SELECT l_orderkey, l_linenumber, company, name FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS company FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5, 8)) JOIN companies ON code = company", CONNECTIONS)
def runs_of_my_companies(spark, d):
    """Import runs of some companies with their names."""
    runs = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("company"))
    return business.synchronised(runs, _connections(spark, d)[1], [1, 2, 3, 5, 8])


@query("SELECT c.id, c.name, coalesce(string_agg(a.code || ' ' || a.name, ',' ORDER BY a.code), '') AS companies, count(a.code) AS n FROM connections c LEFT JOIN companies a ON a.connection = c.id GROUP BY 1, 2", CONNECTIONS)
def connection_companies(spark, d):
    """Each connection with the list of its companies, empty for some."""
    connections, companies = _connections(spark, d)
    rows = business.connection_lists(connections, companies)
    listed = F.array_join(F.transform("companies", lambda c: F.concat(c["code"].cast("string"), F.lit(" "), c["name"])), ",")
    return rows.select("id", "name", listed.alias("companies"), F.size("companies").cast("long").alias("n"))


@query("""SELECT s.id AS source_id, count(*) FILTER (WHERE c.id IS NOT NULL AND lang IS NOT NULL AND length(content) >= 300) AS n_indexed, count(*) FILTER (WHERE c.id IS NOT NULL AND length(content) < 300) AS n_errors, max(c.id) AS last_update
 FROM sources s LEFT JOIN chunks c ON c.source_id = s.id GROUP BY s.id""", SOURCES, CHUNKS)
def source_states(spark, d):
    """Indexed documents, errors and the last update of each source."""
    state = F.when(F.length("content") < 300, "error").when(F.col("lang").isNotNull(), "indexed").otherwise("waiting")
    return reports.source_states(sources(spark, d), chunks(spark, d).select("source_id", state.alias("state"), F.col("id").alias("updated_at")))


@query("""SELECT src_kind, relation, dst_kind, count(*) AS n FROM (SELECT 'customer' AS src_kind, c_mktsegment AS relation, 'nation' AS dst_kind FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'supplier', '', 'nation' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'nation', 'part of', '?' FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY 1, 2, 3""")
def edge_kinds(spark, d):
    """Edges of a graph by the kinds of their ends."""
    node = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    kinds = [("customer", "c", "c_custkey", "customer"), ("supplier", "s", "s_suppkey", "supplier"), ("nation", "n", "n_nationkey", "nation"), ("region", "r", "r_regionkey", None)]
    nodes = None
    for table, prefix, key, kind in kinds:
        part = read(spark, d, table).select(node(prefix, key).alias("node"), F.lit(kind).cast("string").alias("kind"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = read(spark, d, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"), F.col("c_mktsegment").alias("relation"))
    edges = edges.unionByName(read(spark, d, "supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"), F.lit(None).cast("string").alias("relation")))
    edges = edges.unionByName(read(spark, d, "nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("part of").alias("relation")))
    return reports.edge_kinds(nodes, edges)


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS day, l_partkey, CAST(sum(CASE WHEN year(l_shipdate) = 1995 THEN l_quantity * 2 ELSE l_quantity END) AS BIGINT) AS stock FROM lineitem GROUP BY 1, 2""")
def snapshot_read_back(spark, d):
    """Stock by period, written by period: a second reading of 1995 replaces those periods and leaves the others."""
    path = f"{work_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = read(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("day"), "l_partkey").agg(F.sum("l_quantity").cast("long").alias("stock"))
    files.write_snapshot(rows, path)
    files.write_snapshot(rows.where("day like '1995%'").withColumn("stock", F.col("stock") * 2), path)
    return spark.read.schema(rows.schema).parquet(path).select("day", "l_partkey", "stock")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus || ';\"' || o_orderpriority AS note, '{\"status\":\"' || o_orderstatus || '\",\"customer\":' || o_custkey || '}' AS detail FROM orders")
def csv_export(spark, d):
    """An export for spreadsheets and what a reader finds in it: quotes and separators kept, structures as JSON."""
    path = f"{work_dir(spark)}/export-{uuid.uuid4().hex}"
    rows = read(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(';"'), "o_orderpriority").alias("note"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("detail"))
    files.export_csv(rows, path)
    return files.read_export(spark, path)


@query("SELECT o.o_orderkey FROM orders o WHERE NOT (hour(o_orderdate + o_orderkey % 1440 * INTERVAL 1 MINUTE) >= 22 OR hour(o_orderdate + o_orderkey % 1440 * INTERVAL 1 MINUTE) < 6) AND o_totalprice * 1000 > 50 * 1024 * 1024")
def deferred_files(spark, d):
    """Files that wait for the night: large ones outside the window."""
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = read(spark, d, "orders").withColumn("at", at)
    return rows.where(ingest.deferred(F.col("o_totalprice") * 1000, ingest.in_window(F.col("at"), 22 * 60, 6 * 60))).select("o_orderkey")


@query("""SELECT document, page, count(*) AS n, count(*) FILTER (WHERE content LIKE '%Immagine: %') AS n_figures FROM (SELECT source_id, document, page, content FROM chunks
 UNION ALL (SELECT DISTINCT source_id, document, page, CASE WHEN page = 1 THEN 'Cover | ' ELSE '' END || 'Immagine: ' || label || ' of ' || document FROM (SELECT c.*, e.label FROM embeddings e JOIN chunks c ON c.id = e.vec_id WHERE e.label <> 2))) GROUP BY 1, 2""", CHUNKS)
def backfilled_figures(spark, d):
    """Figures written to existing chunks, twice: each is there once."""
    c = chunks(spark, d).select("source_id", "document", "page", "content")
    f = figures(spark, d).where("label <> 2").select("source_id", "document", "page", F.concat(F.when(F.col("page") == 1, "Cover | ").otherwise(""), F.lit("Immagine: "), F.col("label").cast("string"), F.lit(" of "), F.col("document")).alias("content"))
    rows = ingest.backfilled(ingest.backfilled(c, f), f)
    return rows.groupBy("document", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").contains("Immagine: ")).alias("n_figures"))


@query("SELECT s_suppkey, s_name, n_name FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal <= 9000) JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1) ON n_nationkey = s_nationkey")
def current_view_set(spark, d):
    """Views of the current rows of several histories, joined in SQL."""
    stamp = F.lit("1995-01-01").cast("timestamp_ntz")
    versioned = lambda rows, gone: rows.withColumn("row_hash", F.lit("")).withColumn("valid_from", stamp).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).withColumn("deleted", gone)
    own = spark.newSession()
    s = versioned(read(own, d, "supplier"), F.col("s_acctbal") > 9000)
    n = versioned(read(own, d, "nation"), F.col("n_regionkey") == 1)
    closed = s.withColumn("valid_to", F.lit("1996-01-01").cast("timestamp_ntz")).withColumn("s_name", F.lit("old name"))
    history.current_views(own, {"suppliers": s.unionByName(closed), "nations": n})
    return own.sql("SELECT s_suppkey, s_name, n_name FROM current_suppliers JOIN current_nations ON n_nationkey = s_nationkey")

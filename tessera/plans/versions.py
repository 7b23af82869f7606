"""Queries on versioned records, imports and business metrics."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import anomalies, business, history, imports
from tessera.sources import connectors
from tessera.sources.generations import work_dir

from .base import PRICES, prices, query, read

T0, T1 = "1995-01-01 00:00:00", "1996-01-01 00:00:00"


def _history(spark, d):
    """Customers of the first load: half of them, some of another state."""
    c = read(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("acme:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("acme").alias("company"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    rows = c.withColumn("row_hash", history.row_hash(["segment", "nation"])).withColumn("valid_from", F.lit(T0).cast("timestamp_ntz")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    rows = rows.withColumn("deleted", F.expr("cast(split(id, ':')[1] as long) % 7 = 0"))
    return rows.select("id", "company", "segment", "nation", "row_hash", "valid_from", "valid_to", "deleted")


def _incoming(spark, d):
    """The second load: other customers are missing, some changed."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").where(k % 4 != 0).select(F.concat(F.lit("acme:"), k.cast("string")).alias("id"), F.lit("acme").alias("company"), F.when(k % 6 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))


HASH = """sha256('{"nation":' || coalesce(CAST(nation AS VARCHAR), 'null') || ',"segment":' || coalesce('"' || segment || '"', 'null') || '}')"""
OLD = f"old AS (SELECT *, {HASH} AS h FROM (SELECT 'acme:' || c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, c_custkey % 7 = 0 AS deleted FROM customer WHERE c_custkey % 5 <> 0))"
NEW = f"new AS (SELECT *, {HASH} AS h FROM (SELECT 'acme:' || c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 4 <> 0))"


def _merged_sql(full: bool) -> str:
    gone = "n.id IS NULL AND NOT o.deleted" if full else "false"
    return f"""merged AS (
 SELECT o.id, o.segment, o.nation, o.h AS row_hash, TIMESTAMP '{T0}' AS valid_from, CASE WHEN n.id IS NOT NULL AND (o.deleted OR n.h <> o.h) OR {gone} THEN TIMESTAMP '{T1}' END AS valid_to, o.deleted FROM old o LEFT JOIN new n ON n.id = o.id
 UNION ALL SELECT n.id, n.segment, n.nation, n.h, TIMESTAMP '{T1}', NULL, false FROM new n LEFT JOIN old o ON o.id = n.id WHERE o.id IS NULL OR o.deleted OR n.h <> o.h
 UNION ALL SELECT o.id, o.segment, o.nation, o.h, TIMESTAMP '{T1}', NULL, true FROM old o LEFT JOIN new n ON n.id = o.id WHERE {gone})"""


@query("SELECT * FROM merged", OLD, NEW, _merged_sql(True))
def history_merge_full(spark, d):
    """A full load: changes, arrivals, deletions, and one that comes back."""
    return history.merge(_history(spark, d), _incoming(spark, d), F.lit(T1).cast("timestamp_ntz"), True).drop("company")


@query("SELECT * FROM merged", OLD, NEW, _merged_sql(False))
def history_merge_incremental(spark, d):
    """An incremental load leaves absent rows as they are."""
    return history.merge(_history(spark, d), _incoming(spark, d), F.lit(T1).cast("timestamp_ntz"), False).drop("company")


@query("SELECT id, segment FROM merged WHERE valid_to IS NULL AND NOT deleted", OLD, NEW, _merged_sql(True))
def history_current(spark, d):
    """The current view after a merge."""
    return history.current(history.merge(_history(spark, d), _incoming(spark, d), F.lit(T1).cast("timestamp_ntz"), True)).select("id", "segment")


@query("SELECT id, segment FROM merged WHERE valid_from <= TIMESTAMP '1995-06-01' AND (valid_to IS NULL OR TIMESTAMP '1995-06-01' < valid_to) AND NOT deleted", OLD, NEW, _merged_sql(True))
def history_as_of(spark, d):
    """What was valid at a moment."""
    rows = history.merge(_history(spark, d), _incoming(spark, d), F.lit(T1).cast("timestamp_ntz"), True)
    return history.as_of(rows, F.lit("1995-06-01").cast("timestamp_ntz")).select("id", "segment")


@query("SELECT id, h AS row_hash FROM new", NEW)
def history_row_hash(spark, d):
    """Hashes of canonical business columns."""
    return _incoming(spark, d).select("id", history.row_hash(["segment", "nation"]).alias("row_hash"))


@query("SELECT count(*) AS broken FROM (SELECT 1 WHERE false)")
def history_broken_intervals(spark, d):
    """No version overlaps another after a merge."""
    rows = history.merge(_history(spark, d), _incoming(spark, d), F.lit(T1).cast("timestamp_ntz"), True)
    return history.broken_intervals(rows).agg(F.count(F.lit(1)).alias("broken"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def last_wins(spark, d):
    """The last row of each key in a batch."""
    return history.last_wins(read(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority AS entity, count(*) AS n_before, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_now, count(*) >= 2 AND count(*) FILTER (WHERE o_orderstatus = 'P') < 0.5 * count(*) AS blocked, CAST(floor((1 - count(*) FILTER (WHERE o_orderstatus = 'P') / count(*)) * 100) AS BIGINT) AS percent FROM orders GROUP BY o_orderpriority")
def collapse_check(spark, d):
    """Full loads that shrank to less than half are blocked."""
    rows = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity")).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("o_orderstatus") == "P").alias("n_now"))
    return rows.withColumn("blocked", history.is_collapsed(F.col("n_before"), F.col("n_now"))).withColumn("percent", history.fall(F.col("n_before"), F.col("n_now")))


@query("SELECT 'acme:' || o_orderkey AS id, 'acme:' || o_custkey AS customer_id FROM orders")
def namespaced_keys(spark, d):
    """Company-prefixed keys and references."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    return rows.select(*[c.alias(n) for n, c in history.namespaced(F.lit("acme"), "id", "customer_id").items()])


@query("SELECT 'acme' AS company, max(o_orderdate) AS mark, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def incremental_extract(spark, d):
    """Rows after the mark, and the next mark."""
    rows = read(spark, d, "orders").withColumnRenamed("o_orderdate", "modified_at")
    rows = connectors.extracted(rows, "acme", "1996-01-01")
    return connectors.high_water(rows).join(rows.groupBy("company").agg(F.count(F.lit(1)).alias("n")), "company")


def _orders_connector(d, until=None):
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    return connectors.ParquetConnector("order_system", {"orders": (kinds, f"{d}/orders.parquet")}, "o_orderdate", until)


@query("SELECT 'acme' AS company, o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS mark FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-01' GROUP BY 2")
def connector_pull(spark, d):
    """Orders through a connector that is a Spark format: the filter on the time of change is its own."""
    rows = connectors.pulled(spark, _orders_connector(d), "orders", "acme")
    rows = rows.where((F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") <= F.lit("1997-06-01").cast("timestamp_ntz")))
    return rows.groupBy("company", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("mark"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def connector_stream(spark, d):
    """All orders as a stream of changes, stopped half way and begun again: each row once."""
    folder = f"{work_dir(spark)}/orders-{uuid.uuid4().hex}"
    for until in (dt.datetime(1995, 6, 1), None):
        connectors.changes_into(spark, _orders_connector(d, until), "orders", f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/rows").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT coalesce(n.k, o.k) AS entity, coalesce(n.cursor, o.cursor) AS cursor, coalesce(n.outcome, o.outcome) AS outcome FROM (SELECT r_name AS k, 'c' || r_regionkey AS cursor, 'ok' AS outcome FROM region WHERE r_regionkey < 4) o FULL JOIN (SELECT r_name AS k, NULL AS cursor, 'error' AS outcome FROM region WHERE r_regionkey > 1) n ON n.k = o.k")
def status_upsert(spark, d):
    """A status keeps its old cursor where an update has none."""
    r = read(spark, d, "region")
    old = r.where("r_regionkey < 4").select(F.col("r_name").alias("entity"), F.concat(F.lit("c"), "r_regionkey").alias("cursor"), F.lit("ok").alias("outcome"))
    new = r.where("r_regionkey > 1").select(F.col("r_name").alias("entity"), F.lit(None).cast("string").alias("cursor"), F.lit("error").alias("outcome"))
    return history.upserted(old, new, "entity")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority < '3')")
def conformance_unstable_ids(spark, d):
    """Ids that only one of two extractions has."""
    o = read(spark, d, "orders")
    assert history.nonconforming({"id", "iban", "name"}, {"id", "name", "iban"}, {"iban"}) == ["iban"]
    return history.unstable(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority < '3'"), "o_orderkey")


@query("""SELECT company, entity, every_minutes FROM (SELECT c.company, c.entity, coalesce(o.every_minutes, c.default_minutes) AS every_minutes, coalesce(o.enabled, true) AS enabled, s.last_run
 FROM (SELECT n_name AS company, r_name AS entity, CAST(60 * (1 + n_nationkey % 4) AS INTEGER) AS default_minutes FROM nation JOIN region ON r_regionkey = n_regionkey) c
 LEFT JOIN (SELECT n_name AS company, r_name AS entity, TIMESTAMP '2024-01-01 12:00:00' - n_nationkey * INTERVAL 10 MINUTE AS last_run FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 6 <> 0) s USING (company, entity)
 LEFT JOIN (SELECT n_name AS company, r_name AS entity, CASE WHEN n_nationkey % 5 = 0 THEN 15 END AS every_minutes, n_nationkey % 7 <> 0 AS enabled FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0) o USING (company, entity))
 WHERE enabled AND (last_run IS NULL OR date_diff('minute', last_run, TIMESTAMP '2024-01-01 12:00:00') >= every_minutes)""")
def schedule_due(spark, d):
    """Entities that are due, by default or overridden frequency."""
    base = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("company"), F.col("r_name").alias("entity"), F.col("n_nationkey").alias("k"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    catalogue = base.select("company", "entity", (60 * (1 + F.col("k") % 4)).cast("int").alias("default_minutes"))
    status = base.where("k % 6 <> 0").select("company", "entity", (now - F.make_interval(mins=F.col("k") * 10)).alias("last_run"))
    overrides = base.where("k % 5 = 0 or k % 7 = 0").select("company", "entity", F.when(F.col("k") % 5 == 0, 15).alias("every_minutes"), (F.col("k") % 7 != 0).alias("enabled"))
    return history.due(catalogue, status, overrides, now)


T2 = "1997-01-01 00:00:00"
COLUMNS = "segment string, nation int"
LOADS = f"""l1 AS (SELECT 'acme:' || c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_acctbal > -500),
l2 AS (SELECT 'acme:' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'GOLD' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_nationkey <> 3),
l3 AS (SELECT 'acme:' || c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_acctbal > 7000 AND c_nationkey < 20),
h1 AS (SELECT *, TIMESTAMP '{T0}' AS valid_from, NULL::TIMESTAMP AS valid_to, false AS deleted FROM l1),
h2 AS (SELECT h.id, h.segment, h.nation, valid_from, CASE WHEN l.id IS NULL OR l.segment <> h.segment OR l.nation <> h.nation THEN TIMESTAMP '{T1}' END AS valid_to, deleted FROM h1 h LEFT JOIN l2 l USING (id)
 UNION ALL SELECT l.*, TIMESTAMP '{T1}', NULL, false FROM l2 l LEFT JOIN h1 h USING (id) WHERE h.id IS NULL OR l.segment <> h.segment OR l.nation <> h.nation
 UNION ALL SELECT h.id, h.segment, h.nation, TIMESTAMP '{T1}', NULL, true FROM h1 h LEFT JOIN l2 l USING (id) WHERE l.id IS NULL),
h3 AS (SELECT h.id, h.segment, h.nation, valid_from, CASE WHEN valid_to IS NOT NULL THEN valid_to WHEN l.id IS NOT NULL AND (deleted OR l.segment <> h.segment OR l.nation <> h.nation) THEN TIMESTAMP '{T2}' END AS valid_to, deleted FROM h2 h LEFT JOIN l3 l USING (id)
 UNION ALL SELECT l.*, TIMESTAMP '{T2}', NULL, false FROM l3 l LEFT JOIN (SELECT * FROM h2 WHERE valid_to IS NULL) h USING (id) WHERE h.id IS NULL OR deleted OR l.segment <> h.segment OR l.nation <> h.nation)"""


def _stored(spark, d) -> history.StoredHistory:
    """A first load, a full one that changes, adds and drops customers, and an incremental one that brings some back."""
    kept = history.StoredHistory(spark, f"{work_dir(spark)}/history-{uuid.uuid4().hex}", COLUMNS, 8)
    c = read(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment", "c_nationkey": "nation"}).withColumn("nation", F.col("nation").cast("int")).withColumn("company", F.lit("acme")).withColumn("seq", F.lit(1))
    rows = lambda x: x.select("id", "company", "segment", "nation", "seq")
    gold = F.when(F.col("c_acctbal") > 5000, "GOLD").otherwise(F.col("segment"))
    loads = [(rows(c.where("c_acctbal > -500")), T0, True), (rows(c.where("nation <> 3").withColumn("segment", gold)), T1, True), (rows(c.where("c_acctbal > 7000 and nation < 20")), T2, False)]
    for incoming, moment, full in loads:
        assert kept.load(incoming, [], "seq", F.lit(moment).cast("timestamp_ntz"), full) == "ok"
    return kept


@query("SELECT * FROM h3", LOADS)
def stored_history(spark, d):
    """All versions of a stored history after three loads."""
    return _stored(spark, d).versions().select("id", "segment", F.col("nation").cast("long").alias("nation"), "valid_from", "valid_to", "deleted")


@query(
    """SELECT status, CAST(sum(is_open) AS BIGINT) AS n_open, CAST(sum(1 - is_open) AS BIGINT) AS n_closed, 'blocked' AS outcome, (SELECT 'collapsed by ' || CAST(floor((1 - count(*) FILTER (WHERE o_orderkey % 10 = 1) / count(*)) * 100) AS INTEGER) || ' %' FROM orders) AS reason,
 (SELECT max(modified) FROM second) AS mark, 'resolved' AS error_state, 'open' AS blocked_state
FROM (SELECT status, 1 AS is_open FROM second UNION ALL SELECT o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END FROM orders, m WHERE o_orderdate <= mark) GROUP BY status""",
    "m AS (SELECT max(o_orderdate) AS mark FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')",
    "second AS (SELECT CASE WHEN o_orderdate <= mark THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderdate <= mark THEN TIMESTAMP '1999-01-01' ELSE o_orderdate END AS modified FROM orders, m WHERE o_orderdate > mark OR o_orderkey % 10 = 0)",
)
def import_runs(spark, d):
    """Four runs of an import: the first part, one that fails in its tasks, what is behind the mark, and a full load that is blocked."""
    kept = history.StoredHistory(spark, f"{work_dir(spark)}/imports-{uuid.uuid4().hex}", "status string", 8)
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"))
    year = F.lit("1996-01-01").cast("timestamp_ntz")

    def behind(mark):
        late = F.lit("1999-01-01").cast("timestamp_ntz")
        changes = o.where((F.col("modified") <= F.lit(mark)) & (F.col("id") % 10 == 0)).withColumns({"status": F.lit("X"), "modified": late})
        return o.where(F.col("modified") > F.lit(mark)).unionByName(changes)

    steps = [
        (lambda mark: o.where(F.col("modified") < year), False),
        (lambda mark: o.withColumn("status", F.when(F.col("id") % 100 == 0, F.raise_error(F.lit("source gone")).cast("string")).otherwise(F.col("status"))), False),
        (behind, False),
        (lambda mark: o.where("id % 10 = 1"), True),
    ]
    runs, mark, status = [], None, spark.createDataFrame([], imports.STATUS)
    for i, (extract, full) in enumerate(steps):
        runs.append(imports.run_import(kept, "acme/orders", "acme", extract, "modified", dt.datetime(2000, 1, 1 + i), full, mark))
        mark = runs[-1][3] or mark
        status = imports.status_after(spark, status, runs[-1:])
    states = anomalies.folded(imports.signals_of(spark, runs)).agg(*[F.max(F.when(F.col("fingerprint") == f"import:acme/orders:{p}", F.col("state"))).alias(f"{p}_state") for p in ("error", "blocked")])
    counts = kept.versions().groupBy("status").agg(F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.count_if(F.col("valid_to").isNotNull()).alias("n_closed"))
    # one row of status and one of states
    ended = status.select("import", "outcome", "reason", "mark").join(states.withColumn("import", F.lit("acme/orders")), "import").drop("import")
    return counts.join(ended)


@query(f"SELECT c.id, c.segment, a.segment AS was FROM (SELECT * FROM h3 WHERE valid_to IS NULL AND NOT deleted) c LEFT JOIN (SELECT * FROM h3 WHERE valid_from <= TIMESTAMP '1995-06-01' AND (valid_to IS NULL OR TIMESTAMP '1995-06-01' < valid_to) AND NOT deleted) a USING (id)", LOADS)
def stored_history_current(spark, d):
    """Current rows of a stored history, read from open versions only, beside what was valid in 1995."""
    kept = _stored(spark, d)
    was = kept.as_of(F.lit("1995-06-01").cast("timestamp_ntz")).select("id", F.col("segment").alias("was"))
    return kept.current().select("id", "segment").join(was, "id", "left")


@query("SELECT l.l_orderkey, l.l_linenumber, p.o_orderkey AS version FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN prices p ON p.o_custkey = o.o_custkey AND p.valid_from <= l.l_shipdate AND (p.valid_to IS NULL OR l.l_shipdate < p.valid_to)", PRICES)
def as_of_join(spark, d):
    """Each line with the version of its customer at the ship date."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    versions = prices(spark, d).select("o_custkey", F.col("o_orderkey").alias("version"), "valid_from", "valid_to")
    return history.as_of_join(lines, versions, "o_custkey", "l_shipdate").select("l_orderkey", "l_linenumber", "version")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_extendedprice / l_quantity), 4) AS price, count(*) AS n FROM lineitem GROUP BY 1")
def monthly_price(spark, d):
    """Average price of each month."""
    return business.monthly(read(spark, d, "lineitem"), "l_shipdate", price=F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4), n=F.count(F.lit(1)))


@query("SELECT strftime(l.l_shipdate, '%Y-%m') AS month, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24, 8))), 2) AS DOUBLE) AS revenue, CAST(round(sum(CAST(coalesce(CASE WHEN l_tax > 0.04 THEN l_tax * l_extendedprice END, p.o_totalprice * 0.001) AS DECIMAL(24, 8))), 2) AS DOUBLE) AS cost FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN prices p ON p.o_custkey = o.o_custkey AND p.valid_from <= l.l_shipdate AND (p.valid_to IS NULL OR l.l_shipdate < p.valid_to) GROUP BY 1", PRICES)
def monthly_margin(spark, d):
    """Revenue and cost; a line without a cost takes that of its customer's version. Sums are exact: no order of rows decides a tie."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    versions = prices(spark, d).select("o_custkey", F.col("o_totalprice").alias("base"), "valid_from", "valid_to")
    rows = history.as_of_join(lines, versions, "o_custkey", "l_shipdate")
    own = F.when(F.col("l_tax") > 0.04, F.col("l_tax") * F.col("l_extendedprice"))
    exact = lambda c: F.round(F.sum(c.cast("decimal(24,8)")), 2).cast("double")
    return business.monthly(rows, "l_shipdate", revenue=exact(F.col("l_extendedprice") * (1 - F.col("l_discount"))), cost=exact(F.coalesce(own, F.col("base") * 0.001)))


@query("SELECT p.o_orderstatus AS agent, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN prices p ON p.o_custkey = o.o_custkey AND p.valid_from <= l.l_shipdate AND (p.valid_to IS NULL OR l.l_shipdate < p.valid_to) GROUP BY 1", PRICES)
def revenue_by_agent(spark, d):
    """Revenue by who was responsible at the date."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    versions = prices(spark, d).select("o_custkey", F.col("o_orderstatus").alias("agent"), "valid_from", "valid_to")
    return history.as_of_join(lines, versions, "o_custkey", "l_shipdate", "inner").groupBy("agent").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT kind, code, description FROM (SELECT 'region' AS kind, CAST(r_regionkey AS VARCHAR) AS code, r_name AS description FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'segment', substr(c_mktsegment, 1, 3), min(c_mktsegment) FROM customer GROUP BY 2)")
def code_union(spark, d):
    """Three code tables as one."""
    r = read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("description"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description"))
    s = read(spark, d, "customer").groupBy(F.substring("c_mktsegment", 1, 3).alias("code")).agg(F.min("c_mktsegment").alias("description"))
    return business.code_table(("region", r), ("nation", n), ("segment", s))


@query("SELECT p_partkey, kind, value FROM (SELECT p_partkey, unnest(['p_brand', 'p_type']) AS kind, unnest([p_brand, CASE WHEN p_size < 10 THEN '' ELSE p_type END]) AS value FROM part) WHERE coalesce(value, '') <> ''")
def code_unpivot(spark, d):
    """Two code columns as rows."""
    rows = read(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")).alias("p_type"))
    return business.unpivoted(rows, ["p_partkey"], ["p_brand", "p_type"])


@query("SELECT l_orderkey, min(l_returnflag) FILTER (WHERE l_linenumber = 1) AS a1, min(l_returnflag) FILTER (WHERE l_linenumber = 2) AS a2, min(l_returnflag) FILTER (WHERE l_linenumber = 3) AS a3 FROM lineitem GROUP BY l_orderkey")
def attribute_pivot(spark, d):
    """Attribute rows as columns in one aggregation."""
    rows = read(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("value"))
    return business.pivoted(rows, ["l_orderkey"], ["a1", "a2", "a3"])


@query("SELECT p.p_partkey, p.p_name, n.n_name AS origin, r.r_name AS area FROM part p LEFT JOIN nation n ON n.n_nationkey = p.p_size LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND p.p_brand <> ''")
def product_star(spark, d):
    """Products with several code tables, kept without a code."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    rows = read(spark, d, "part").join(n, F.col("n_nationkey") == F.col("p_size"), "left").join(r, (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("p_brand") != ""), "left")
    return rows.select("p_partkey", "p_name", F.col("n_name").alias("origin"), F.col("r_name").alias("area"))


@query("SELECT o.o_orderkey, c.c_name, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, coalesce(substr(o_orderpriority, 1, 1) IN ('1', 'S', 'V', 'true'), false) AS urgent FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def order_headers(spark, d):
    """Orders with customers, mapped states and decoded flags."""
    c = read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("partial")
    return read(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", state.alias("status"), business.flag(F.substring("o_orderpriority", 1, 1)).alias("urgent"))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name, round(l_extendedprice * (1 - l_discount * 10 / 100) * (1 - l_tax * 10 / 100), 9) AS net FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P' LEFT JOIN part p ON p.p_partkey = l.l_partkey")
def order_lines(spark, d):
    """Lines of valid orders with products and cascading discounts."""
    o = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    net = business.discounted(F.col("l_extendedprice"), F.array(F.col("l_discount") * 10, F.lit(None).cast("double"), F.col("l_tax") * 10))
    return read(spark, d, "lineitem").join(o, "l_orderkey").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_name", F.round(net, 9).alias("net"))


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS role FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer WHERE c_acctbal > 0")
def subjects_with_roles(spark, d):
    """Suppliers and customers as subjects with roles."""
    s = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("role"))
    c = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("role"))
    return s.unionByName(c)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_gaps(spark, d):
    """References without a parent."""
    return business.referential_gaps(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("SELECT o_custkey AS company, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_ok FROM orders GROUP BY o_custkey")
def last_ok_import(spark, d):
    """When each company's last good import was."""
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_ok"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS day, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS stock FROM lineitem GROUP BY 1, 2")
def daily_snapshot(spark, d):
    """Stock by period and item, one row a key."""
    return read(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("day"), "l_partkey").agg(F.sum("l_quantity").cast("long").alias("stock"))


@query("SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS change FROM orders")
def price_changes(spark, d):
    """Change of each version against the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("change"))

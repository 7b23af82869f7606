"""Queries on ingestion, pieces, operations and evaluation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import acl, text, vectors
from tessera.operators import anomalies, chunking, evaluation, ingest, reports, retrieval
from tessera.sources import files
from tessera.sources.generations import work_dir
from tessera.streaming import anomalies as stream

from .base import ALLOWED, CHUNKS, FIGURES, SOURCES, VECTORS, WHO, WORDS, chunks, figures, postings, query, query_vector, read, sources, with_vectors
from .search import _nearest_sql


@query("SELECT path, ext, reader FROM (SELECT path, ext, CASE WHEN ext IN ('pdf', 'md') THEN 'layout' WHEN ext = 'txt' THEN 'text' WHEN ext = 'csv' THEN 'sheet' ELSE 'excluded' END AS reader FROM (SELECT 'f' || (doc_id % 5) || '/' || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE 'd' END || doc_id || '.' || ['PDF', 'txt', 'csv', 'doc', 'exe', 'md'][doc_id % 6 + 1] AS path, lower(['PDF', 'txt', 'csv', 'doc', 'exe', 'md'][doc_id % 6 + 1]) AS ext, doc_id FROM documents) WHERE doc_id % 7 <> 0 AND ext <> 'exe')")
def file_classes(spark, d):
    """Files by reader class; hidden and unknown ones are left out."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("PDF", "txt", "csv", "doc", "exe", "md")]), (i % 6 + 1).cast("int"))
    path = F.concat(F.lit("f"), (i % 5).cast("string"), F.lit("/"), F.when(i % 7 == 0, "_").otherwise("d"), i.cast("string"), F.lit("."), ext)
    return ingest.readable_files(read(spark, d, "documents").select(path.alias("path")))


PRESENT = "present AS (SELECT 'p' || CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END || doc_id AS path, CAST(n_chars AS BIGINT) AS size, doc_id % 13 AS mtime, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE '' END || doc_id AS hash FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'copy' || doc_id, CAST(n_chars AS BIGINT), 1, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE '' END || doc_id FROM documents WHERE doc_id % 20 = 3)"
MANIFEST = "manifest AS (SELECT 'p' || doc_id AS path, CAST(n_chars AS BIGINT) AS size, doc_id % 13 - CAST(doc_id % 11 = 0 OR doc_id % 17 = 0 AS INTEGER) AS mtime, CAST(doc_id AS VARCHAR) AS hash FROM documents WHERE doc_id % 5 <> 0)"


def _scan(spark, d):
    c = read(spark, d, "documents")
    i = F.col("doc_id")
    h = F.concat(F.when(i % 11 == 0, "changed").otherwise(""), i.cast("string"))
    a = c.where("doc_id % 4 <> 0").select(F.concat(F.lit("p"), F.when(i % 9 == 0, "x").otherwise(""), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), (i % 13).alias("mtime"), h.alias("hash"))
    b = c.where("doc_id % 20 = 3").select(F.concat(F.lit("copy"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime"), h.alias("hash"))
    known = c.where("doc_id % 5 <> 0").select(F.concat(F.lit("p"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"), (i % 13 - ((i % 11 == 0) | (i % 17 == 0)).cast("int")).alias("mtime"), i.cast("string").alias("hash"))
    return a.unionByName(b), known


@query("""SELECT state, count(*) AS n, CAST(count(old_path) AS BIGINT) AS n_old, min(path) AS first FROM (
 SELECT p.path, CASE WHEN p.size = m.size AND p.mtime = m.mtime THEN 'unchanged' WHEN p.hash = m.hash THEN 'touched' ELSE 'changed' END AS state, NULL AS old_path FROM present p JOIN manifest m USING (path)
 UNION ALL SELECT path, state, CASE WHEN k = 1 THEN gone END FROM (SELECT p.path, g.gone, p.k, CASE WHEN g.gone IS NOT NULL AND p.k = 1 THEN 'moved' WHEN h.hash IS NOT NULL OR g.gone IS NOT NULL THEN 'duplicate' ELSE 'new' END AS state
  FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM present WHERE path NOT IN (SELECT path FROM manifest)) p LEFT JOIN gone g ON g.hash = p.hash LEFT JOIN (SELECT DISTINCT hash FROM manifest WHERE path IN (SELECT path FROM present)) h ON h.hash = p.hash)
 UNION ALL SELECT path, 'removed', NULL FROM manifest m WHERE path NOT IN (SELECT path FROM present) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.gone = m.path AND EXISTS (SELECT 1 FROM present p WHERE p.hash = g.hash AND p.path NOT IN (SELECT path FROM manifest)))) GROUP BY state""", PRESENT, MANIFEST, "gone AS (SELECT hash, min(path) AS gone FROM manifest WHERE path NOT IN (SELECT path FROM present) GROUP BY hash)")
def incremental_difference(spark, d):
    """Files that are unchanged, touched, changed, new, moved, copied or removed."""
    rows = ingest.differences(*_scan(spark, d))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("old_path").alias("n_old"), F.min("path").alias("first"))


@query("SELECT source AS source_id, count(*) AS n_known FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 20 < 5) GROUP BY source")
def emptied_sources(spark, d):
    """Known sources of which a scan finds nothing."""
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    return ingest.emptied(rows, rows.where("doc_id % 20 < 5"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0 AND value >= 6")
def retry_candidates(spark, d):
    """Failed documents that may be tried again."""
    error = F.when(F.col("event_id") % 3 == 0, "Read timeout").otherwise("bad format")
    return read(spark, d, "events").where(ingest.to_retry(F.col("event_type"), error, F.col("value"))).select("event_id")


@query("SELECT fingerprint, count(*) AS n, min(document) AS first FROM (SELECT sha256(content) AS fingerprint, lpad(CAST(id AS VARCHAR), 9, '0') AS document FROM chunks) GROUP BY 1 HAVING count(*) > 1", CHUNKS)
def duplicate_documents(spark, d):
    """Contents that several documents share."""
    rows = chunks(spark, d).select(F.sha2("content", 256).alias("fingerprint"), F.lpad(F.col("id").cast("string"), 9, "0").alias("document"))
    return ingest.duplicates(rows, "fingerprint", "document")


@query("SELECT source_id, count(*) AS n FROM (SELECT DISTINCT source_id, lang, page, sha256(content) AS h FROM chunks) GROUP BY source_id", CHUNKS)
def unique_chunks(spark, d):
    """Chunks after removal of repeats; a null page equals a null page."""
    rows = chunks(spark, d).withColumn("document", F.col("lang"))
    return ingest.unique_chunks(rows).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT id, CAST(len(list_filter(regexp_split_to_array(content, '\n[ \t]*\n|\n'), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM chunks WHERE len(list_filter(regexp_split_to_array(content, '\n[ \t]*\n|\n'), lambda x: trim(x) <> '')) > 0", CHUNKS)
def paragraph_counts(spark, d):
    """Paragraphs of plain texts."""
    return ingest.paragraphs(chunks(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT id, substr(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '```'))[1:3], ' '), 1, 160) AS title FROM chunks", CHUNKS)
def page_titles(spark, d):
    """The first lines with text of each page."""
    return chunks(spark, d).select("id", ingest.page_title(F.col("content")).alias("title"))


@query("SELECT label, count(*) AS n, count(CASE WHEN label % 4 < 3 THEN 1 END) AS n_valid FROM embeddings GROUP BY label")
def figure_verdicts(spark, d):
    """Verdict lines of descriptions; others than the three don't count."""
    v = F.element_at(F.array(*[F.lit(x) for x in ("Information", "decoration", "TABLE", "maybe")]), (F.col("label") % 4 + 1).cast("int"))
    rows = read(spark, d, "embeddings").select("label", F.concat(F.lit("a chair\nVerdict: "), v, F.lit("\nred")).alias("description"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(ingest.verdict_of(F.col("description"))).alias("n_valid"))


@query("SELECT p_partkey AS id, n, thing, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS colour FROM (SELECT p_partkey, p_size, p_brand, unnest([0, 1]) AS n, unnest([p_type, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END]) AS thing FROM part) WHERE thing <> ''")
def figure_attributes(spark, d):
    """Objects of figures from JSON, placeholders cleaned."""
    one = lambda thing: F.struct(thing.alias("thing"), F.when(F.col("p_size") % 3 == 0, " N/A ").otherwise(F.col("p_brand")).alias("colour"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.array(one(F.col("p_type")), one(F.when(F.col("p_size") % 2 == 0, "none").otherwise(F.col("p_name"))))).alias("attributes"))
    return ingest.attribute_rows(rows).select("id", "n", "thing", "colour")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 5 >= 3 THEN p_size % 5 + 1 ELSE 1 END AS INTEGER) AS n FROM part")
def rechunk_codes(spark, d):
    """Chunks with three or more codes, cut before each."""
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.concat(F.lit(" AB"), i.cast("string"), F.lit(" thing"))), ",")
    listed = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 5, F.lit(1))), lambda i: F.concat(F.lit(" AB"), i.cast("string"), F.lit(" thing"))), ","))
    return read(spark, d, "part").select("p_partkey", F.size(ingest.split_codes(F.concat(F.lit("list"), listed))).alias("n"))


@query("SELECT count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6")
def night_window(spark, d):
    """Events in a window across midnight."""
    return read(spark, d, "events").where(ingest.in_window(F.col("ts"), 22 * 60, 6 * 60)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'page ' || p_size WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS caption FROM part")
def figure_captions(spark, d):
    """Captions before the dash, cut; the page where there is none."""
    text_ = F.concat(F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")), F.lit(" — shown from above"))
    return read(spark, d, "part").select("p_partkey", ingest.caption(text_, F.col("p_size"), 8).alias("caption"))


@query("SELECT o_orderkey, n, array_to_string([CAST((i * pages) // n AS INTEGER) for i in range(n)], ',') AS sample FROM (SELECT o_orderkey, pages, least(pages, greatest(5, least(12, CAST(floor(pages * 0.05) AS INTEGER)))) AS n FROM (SELECT o_orderkey, CAST(o_orderkey % 400 + 1 AS INTEGER) AS pages FROM orders))")
def sampled_pages(spark, d):
    """Evenly spaced pages for a survey."""
    rows = read(spark, d, "orders").select("o_orderkey", ingest.sampled_pages((F.col("o_orderkey") % 400 + 1).cast("int")).alias("p"))
    return rows.select("o_orderkey", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("sample"))


@query("SELECT coalesce(c.document, f.document) AS document, coalesce(cv, 0) AS chunks_without_vector, coalesce(fv, 0) AS figures_without_vector, coalesce(ft, 0) AS figures_without_text FROM (SELECT document, count(*) FILTER (WHERE e.vec_id IS NULL) AS cv FROM chunks LEFT JOIN embeddings e ON e.vec_id = id GROUP BY document) c FULL JOIN (SELECT document, count(*) FILTER (WHERE label = 1) AS fv, count(*) FILTER (WHERE description = '') AS ft FROM figures GROUP BY document) f ON f.document = c.document", CHUNKS, FIGURES)
def backlog(spark, d):
    """What each document still lacks."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    f = figures(spark, d).withColumn("embedding", F.when(F.col("label") != 1, F.col("embedding")))
    return ingest.manifest_backlog(chunks(spark, d).join(e, "id", "left"), f)


@query("SELECT doc_id AS path_no, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS kept_id, CAST(1 AS BIGINT) AS n_rows_of_id, doc_id % 3 <> 0 AS after_known FROM documents")
def stable_figure_ids(spark, d):
    """Known paths keep their ids over a new reading; others get ids of their own, after all known ones."""
    rows = read(spark, d, "documents").select(F.lit("acme").alias("source_id"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("path_no"))
    old = read(spark, d, "documents").where("doc_id % 3 = 0").select(F.lit("acme").alias("source_id"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("id"))
    known = read(spark, d, "documents").agg(F.max(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))).first()[0]
    ids = ingest.stable_ids(old, rows)
    times = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows_of_id"))
    new = F.col("id") > F.lit(known)
    return ids.join(times, "id").select("path_no", F.when(~new, F.col("id")).alias("kept_id"), "n_rows_of_id", new.alias("after_known"))


@query("SELECT document, count(*) AS n FROM (SELECT document FROM chunks WHERE document NOT IN (SELECT document FROM chunks WHERE id % 30 = 0) UNION ALL SELECT document FROM (SELECT DISTINCT source_id, document, page, content FROM chunks WHERE id % 30 = 0)) GROUP BY document", CHUNKS)
def replaced_documents(spark, d):
    """Documents that were read again replace their old chunks."""
    c = chunks(spark, d)
    whole = c.select("source_id", "document", "page", "content").withColumn("source_id", F.lit("s"))
    again = c.where("id % 30 = 0").select(F.lit("s").alias("source_id"), "document", "page", "content")
    return files.replace_documents(whole, again).groupBy("document").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS document, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit, k) - 1 AS INTEGER) AS ord, 1 AS page, piece
FROM (SELECT doc_id, unit, k, piece FROM cuts WHERE piece <> '' UNION ALL SELECT doc_id, unit, 0, CASE WHEN title IS NULL THEN txt ELSE title || ' | ' || txt END FROM walked LEFT JOIN titles USING (doc_id) WHERE variant)""",
    r"""RECURSIVE lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
squeezed AS (SELECT doc_id, n, trim(regexp_replace(line, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS txt FROM lines),
fragments AS (SELECT doc_id, txt, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, length(txt) AS size,
 length(txt) <= 80 AND len(string_split(txt, ' ')) <= 6 AND regexp_matches(txt, '^[A-Z]{2,5}[-\s]?\d{3,}\b') AS variant FROM squeezed WHERE txt <> '')""",
    "titles AS (SELECT doc_id, substr(arg_min(txt, i), 1, 200) AS title FROM fragments WHERE size >= 15 AND NOT variant GROUP BY doc_id)",
    """walked AS (SELECT doc_id, i, txt, variant, 1 AS unit, CASE WHEN variant THEN 0 ELSE size END AS held FROM fragments WHERE i = 1
 UNION ALL SELECT f.doc_id, f.i, f.txt, f.variant, w.unit + CASE WHEN w.held = 0 OR f.variant OR w.held >= 300 OR w.held + f.size > 1800 THEN 1 ELSE 0 END,
 CASE WHEN f.variant THEN 0 WHEN w.held = 0 OR w.held >= 300 OR w.held + f.size > 1800 THEN f.size ELSE w.held + 1 + f.size END FROM walked w JOIN fragments f ON f.doc_id = w.doc_id AND f.i = w.i + 1)""",
    "units AS (SELECT doc_id, unit, string_agg(txt, chr(10) ORDER BY i) AS whole FROM walked WHERE NOT variant GROUP BY doc_id, unit)",
    r"""places AS (SELECT 1800 AS most, 300 AS least, '(?s)^(.*)\n' AS last_line)""",
    """cuts AS (SELECT doc_id, unit, 0 AS k, '' AS piece, whole AS rest FROM units
 UNION ALL SELECT doc_id, unit, k + 1, trim(substr(rest, 1, place), ' ' || chr(10)), trim(substr(rest, place + 1), ' ' || chr(10))
 FROM (SELECT c.*, CASE WHEN length(rest) <= most THEN length(rest) WHEN regexp_matches(substr(rest, least + 1, most - least), last_line) THEN least + length(regexp_extract(substr(rest, least + 1, most - least), last_line, 1)) ELSE most END AS place FROM cuts c, places WHERE rest <> ''))""",
)
def merged_fragments(spark, d):
    """Fragments of documents joined and cut."""
    return chunking.merge_texts(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document"), F.lit(1).alias("page"), F.col("text").alias("content")))


@query()
def markdown_pieces(spark, d):
    """Pieces of pages under their headings (tested for losing no word, and against fixed cases)."""
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document"), F.lit(1).alias("page"), F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("markdown"))
    return chunking.split_pages(rows)


@query("SELECT s.id AS source_id, s.state, coalesce(n_documents, 0) AS n_documents, coalesce(n_pages, 0) AS n_pages, coalesce(n_chunks, 0) AS n_chunks, last_update FROM sources s LEFT JOIN (SELECT source_id, count(DISTINCT document) AS n_documents, count(DISTINCT (document, page)) AS n_pages, count(*) AS n_chunks, max(id) AS last_update FROM chunks GROUP BY source_id) c ON c.source_id = s.id", SOURCES, CHUNKS)
def source_dashboard(spark, d):
    """Documents, pages and chunks of each source."""
    return reports.source_dashboard(sources(spark, d), chunks(spark, d), "id")


@query("SELECT severity, count(*) AS n, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-02') AS recent, list_position(['high', 'mid', 'low'], severity) AS place FROM (SELECT ts, CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS severity FROM events) GROUP BY severity")
def anomaly_counts(spark, d):
    """Anomalies by severity, all and recent, in their order."""
    s = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "mid").otherwise("low")
    rows = read(spark, d, "events").select("ts", s.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") > F.lit("2024-01-02").cast("timestamp_ntz")).alias("recent"))
    return rows.withColumn("place", F.array_position(F.array(F.lit("high"), F.lit("mid"), F.lit("low")), F.col("severity")).cast("int"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_heartbeat(spark, d):
    """The last event of each monitor."""
    return reports.latest(read(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 30")
def last_thirty(spark, d):
    """The last thirty events of each monitor."""
    return reports.last_n(read(spark, d, "events"), "user_id", "event_id", 30).select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT user_id, CASE WHEN max(CAST(event_type = 'error' AS INTEGER)) = 1 THEN 'critical' WHEN min(CAST(event_type = 'view' AS INTEGER)) = 0 THEN 'attention' ELSE 'ok' END AS light FROM events GROUP BY user_id")
def worst_of(spark, d):
    """A light for each group: the worst of its monitors."""
    return reports.worst_of(read(spark, d, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "view")


@query("SELECT conv_id, turn, max(contains(lower(text), 'thing')) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS tainted FROM conversations")
def conversation_taint(spark, d):
    """Once internal, always internal."""
    return reports.tainted(read(spark, d, "conversations"), text.contains(F.col("text"), "thing")).select("conv_id", "turn", "tainted")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE total <= 1500 OR nth = 1")
def text_budget(spark, d):
    """Turns until a budget of characters is used, one at least."""
    return reports.within_budget(read(spark, d, "conversations"), "conv_id", "turn", "text", 1500).select("conv_id", "turn")


@query("SELECT conv_id, turn, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4")
def context_tail(spark, d):
    """The last turns that stay whole in a context."""
    return reports.last_n(read(spark, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


@query("SELECT l_orderkey, run, l_linestatus, count(*) AS size FROM (SELECT l_orderkey, l_linestatus, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN l_linestatus IS DISTINCT FROM lag(l_linestatus) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_extendedprice))) GROUP BY 1, 2, 3")
def page_runs(spark, d):
    """Runs of equal neighbours."""
    return reports.islands(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice"], "l_linestatus")


@query("SELECT p_partkey AS node, count(l) AS degree FROM part LEFT JOIN (SELECT l_partkey AS l FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) ON l = p_partkey GROUP BY p_partkey")
def node_degree(spark, d):
    """Edges in and out of each node."""
    return reports.degrees(read(spark, d, "part").select(F.col("p_partkey").alias("node")), read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("SELECT user_id, vote, n FROM (SELECT user_id, event_type AS vote, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2) WHERE k = 1")
def majority_vote(spark, d):
    """The most frequent valid vote; ties by the alphabet."""
    return reports.majority(read(spark, d, "events"), "user_id", "event_type", ["view", "click", "error"])


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 5 = 0 THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') AS fields FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def changed_fields(spark, d):
    """Names of the fields that differ."""
    a = read(spark, d, "orders")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")))
    return reports.changed_fields(a, b, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT 'me')")
def people_union(spark, d):
    """People from several lists, each once."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("name"))
    return c.union(read(spark, d, "supplier").select("s_name")).union(spark.createDataFrame([("me",)], "name string")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 5 = 1")
def audit_visibility(spark, d):
    """Log rows of companies written as text lists."""
    listed = F.concat_ws(",", F.when(F.col("o_custkey") % 2 == 0, "acme"), F.when(F.col("o_custkey") % 5 == 1, "borea"), F.lit("other"))
    return read(spark, d, "orders").where(acl.of_companies(listed, ["acme", "borea"])).select("o_orderkey")


@query("SELECT event_id FROM events WHERE (user_id % 3 = 0 OR user_id % 3 = 1) AND event_type IN ('error', 'click')")
def anomaly_visibility(spark, d):
    """Row-level rights of an administrator: company empty or theirs, and their areas."""
    company = F.when(F.col("user_id") % 3 == 1, "acme").when(F.col("user_id") % 3 == 2, "borea")
    return read(spark, d, "events").where(acl.administered(company, F.col("event_type"), ["acme"], ["error", "click"])).select("event_id")


@query("SELECT event_type AS fingerprint FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 95) = 0 OR event_type LIKE 'e%'")
def stale_anomalies(spark, d):
    """Open keys that a round no longer produces."""
    keys = read(spark, d, "events").select(F.col("event_type").alias("fingerprint")).distinct()
    return anomalies.stale(keys, read(spark, d, "events").where("value > 95 and event_type not like 'e%'").select(F.col("event_type").alias("fingerprint")).distinct())


STATES_SQL = """SELECT user_id AS fingerprint, CASE WHEN arg_max(event_type = 'error', (ts, event_id)) THEN 'open' ELSE 'resolved' END AS state, count(*) FILTER (WHERE event_type = 'error') AS occurrences FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id, event_type, min(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS first FROM events) WHERE first IS NOT NULL AND (ts, event_id) >= first GROUP BY 1"""


@query(STATES_SQL)
def anomaly_states(spark, d):
    """Anomalies folded from health polls: down signals, up closes."""
    rows = anomalies.folded(anomalies.health_signals(read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error"))
    return rows.select("fingerprint", "state", "occurrences")


@query(STATES_SQL)
def anomaly_stream(spark, d):
    """The same states from a stream that gets its signals late and out of order, is stopped and begun again, and writes its table as it goes."""
    folder = f"{work_dir(spark)}/signals-{uuid.uuid4().hex}"
    polls = anomalies.health_signals(read(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error").withColumn("at", F.col("at").cast("timestamp"))
    end = polls.agg((F.max("at") + F.make_interval(days=F.lit(30))).alias("at")).select(F.lit("").alias("fingerprint"), "at", F.lit("tick").alias("kind"), F.lit(None).cast("timestamp").alias("until"), F.lit(0).cast("long").alias("seq"))
    # signals arrive up to two days late; a run takes what has come since the last one as one batch, as its files are in no order
    arrived = polls.withColumn("part", F.floor((F.dayofmonth("at") + F.col("seq") % 3) / 8))
    table = stream.StateTable(spark, f"{folder}/states", 4)
    for part in range(5):
        arrived.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        if part == 4:
            end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if part in (2, 4):
            source = spark.readStream.schema(arrived.drop("part").schema).parquet(f"{folder}/in")
            table.follow(stream.folded_stream(source, "3 days"), f"{folder}/checkpoint").awaitTermination()
    return table.read().select("fingerprint", "state", "occurrences")


ACTED = """anomalies AS (SELECT CAST(user_id AS VARCHAR) AS fingerprint, CASE user_id % 3 WHEN 1 THEN 'acme' WHEN 2 THEN 'borea' END AS company FROM (SELECT DISTINCT user_id FROM events)),
actions AS (SELECT event_id AS seq, ts AS moment, CAST(user_id + event_id % 2 AS VARCHAR) AS fingerprint, 'user' || (event_id % 5) AS actor,
 CASE event_type WHEN 'click' THEN 'take' WHEN 'view' THEN 'comment' WHEN 'purchase' THEN 'resolve' WHEN 'signup' THEN 'ignore' ELSE CASE WHEN value < 5 THEN 'delete' ELSE 'assign' END END AS action,
 CASE WHEN value < 20 THEN ' ' ELSE props END AS text, CASE WHEN value > 40 THEN ' ann ' END AS target, CASE event_id % 5 WHEN 0 THEN '1d' WHEN 1 THEN '7d' WHEN 2 THEN '30d' WHEN 3 THEN 'always' END AS until FROM events),
judged AS (SELECT a.*, CASE WHEN s.fingerprint IS NULL THEN 'refused: no such anomaly' WHEN action = 'take' THEN 'taken' WHEN action = 'assign' THEN CASE WHEN target IS NOT NULL THEN 'assigned' ELSE 'refused: to whom?' END
 WHEN action = 'comment' THEN CASE WHEN trim(text) <> '' THEN 'commented' ELSE 'refused: empty comment' END WHEN action = 'resolve' THEN 'resolved'
 WHEN action = 'ignore' THEN CASE WHEN trim(text) = '' THEN 'refused: a reason is needed' WHEN until IS NULL THEN 'refused: until when?' ELSE 'ignored' END ELSE 'refused: unknown action' END AS outcome
 FROM actions a LEFT JOIN (SELECT fingerprint FROM anomalies WHERE company IS NULL OR company = 'acme') s USING (fingerprint))"""


def _judged(spark, d):
    e, k = read(spark, d, "events"), F.col("user_id")
    states = e.select("user_id").distinct().select(k.cast("string").alias("fingerprint"), F.when(k % 3 == 1, "acme").when(k % 3 == 2, "borea").alias("company"), F.lit("open").alias("state"), F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("timestamp_ntz").alias("ignored_until"), F.lit(True).alias("auto"))
    kind, n = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "click", "take").when(kind == "view", "comment").when(kind == "purchase", "resolve").when(kind == "signup", "ignore").when(F.col("value") < 5, "delete").otherwise("assign")
    until = F.when(n % 5 == 0, "1d").when(n % 5 == 1, "7d").when(n % 5 == 2, "30d").when(n % 5 == 3, "always").otherwise("soon")
    actions = e.select(n.alias("seq"), F.col("ts").alias("at"), (k + n % 2).cast("string").alias("fingerprint"), F.concat(F.lit("user"), (n % 5).cast("string")).alias("actor"), action.alias("action"), F.when(F.col("value") < 20, " ").otherwise(F.col("props")).alias("text"), F.when(F.col("value") > 40, " ann ").alias("target"), until.alias("until"))
    return states, anomalies.judged(states, actions, ["acme"])


@query("SELECT seq, outcome FROM judged", ACTED)
def action_outcomes(spark, d):
    """Manual actions on anomalies: what each did, or why it is refused."""
    return _judged(spark, d)[1].select("seq", "outcome")


@query("""SELECT s.fingerprint, coalesce(arg_max(CASE WHEN outcome IN ('taken', 'assigned') THEN 'taken' ELSE outcome END, seq) FILTER (outcome IN ('taken', 'assigned', 'resolved', 'ignored')), 'open') AS state,
 arg_max(CASE WHEN outcome = 'taken' THEN actor ELSE 'ann' END, seq) FILTER (outcome IN ('taken', 'assigned')) AS assigned_to,
 CASE WHEN arg_max(outcome, seq) FILTER (outcome IN ('resolved', 'ignored')) = 'ignored' THEN max(CASE until WHEN '1d' THEN moment + INTERVAL 1 DAY WHEN '7d' THEN moment + INTERVAL 7 DAY WHEN '30d' THEN moment + INTERVAL 30 DAY END) FILTER (seq = last) END AS ignored_until,
 NOT coalesce(bool_or(outcome = 'resolved'), false) AS auto FROM anomalies s LEFT JOIN (SELECT *, max(seq) FILTER (outcome IN ('resolved', 'ignored')) OVER (PARTITION BY fingerprint) AS last FROM judged) a USING (fingerprint) GROUP BY s.fingerprint""", ACTED)
def anomalies_acted(spark, d):
    """States of anomalies after all manual actions that were not refused."""
    return anomalies.acted(*_judged(spark, d)).select("fingerprint", "state", "assigned_to", "ignored_until", "auto")


@query("SELECT DISTINCT lower(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))) AS q FROM conversations")
def query_dedup(spark, d):
    """Queries of all turns, each once after normalisation."""
    return read(spark, d, "conversations").select(F.lower(text.squeezed(F.col("text"))).alias("q")).dropDuplicates(["q"])


@query("SELECT code, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(['AB' || (p_size % 7), upper(substr(p_brand, 1, 2)) || p_size]) AS code FROM part) WHERE regexp_full_match(code, '[A-Z]{2,}[0-9]+') GROUP BY code HAVING count(DISTINCT p_partkey) <= 60")
def rare_codes(spark, d):
    """Item codes that occur in few chunks."""
    t = F.concat(F.lit("AB"), (F.col("p_size") % 7).cast("string"), F.lit(" and "), F.upper(F.substring("p_brand", 1, 2)), F.col("p_size").cast("string"))
    rows = read(spark, d, "part").select("p_partkey", F.explode(text.codes(t)).alias("code"))
    return rows.groupBy("code").agg(F.countDistinct("p_partkey").alias("n")).where("n <= 60")


@query("SELECT document, CAST(sum(k) AS BIGINT) AS listed, CAST(sum(1 - k) AS BIGINT) AS more FROM (SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY cap) <= 5 AS INTEGER) AS k FROM (SELECT DISTINCT document, page, lower(description) AS cap FROM figures)) GROUP BY document", CHUNKS, FIGURES)
def caption_listing(spark, d):
    """Distinct captions of a document's pages: some listed, the rest counted."""
    rows = figures(spark, d).select("document", "page", F.lower("description").alias("cap")).distinct()
    nth = F.row_number().over(Window.partitionBy("document").orderBy("cap"))
    return rows.withColumn("k", (nth <= 5).cast("int")).groupBy("document").agg(F.sum("k").alias("listed"), F.sum(1 - F.col("k")).alias("more"))


@query("SELECT c_mktsegment AS name, 'manage-' || c_mktsegment AS manager FROM customer GROUP BY 1")
def managed_groups(spark, d):
    """Groups paired with their managers' groups by suffix."""
    g = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    m = read(spark, d, "customer").select(F.concat(F.lit("manage-"), "c_mktsegment").alias("manager")).distinct()
    return g.join(m, F.col("name") == F.regexp_replace("manager", "^manage-", ""))


@query("SELECT l_orderkey, CASE WHEN bad = 0 THEN 'none' WHEN bad = n THEN 'all' ELSE bad || ' of ' || n END AS unverified FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)")
def verification_summary(spark, d):
    """How many of the cited rows are unverified."""
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    return rows.select("l_orderkey", F.when(F.col("bad") == 0, "none").when(F.col("bad") == F.col("n"), "all").otherwise(F.concat_ws(" of ", F.col("bad").cast("string"), F.col("n").cast("string"))).alias("unverified"))


@query("SELECT (SELECT count(*) FROM allowed) AS n_sources, (SELECT count(*) FROM chunks WHERE source_id IN (SELECT id FROM allowed)) AS n_chunks, (SELECT count(DISTINCT document) FROM chunks WHERE source_id IN (SELECT id FROM allowed)) AS n_documents, (SELECT count(DISTINCT (document, page)) FROM chunks WHERE source_id IN (SELECT id FROM allowed)) AS n_pages, (SELECT count(*) FROM figures WHERE source_id IN (SELECT id FROM allowed)) AS n_figures", SOURCES, ALLOWED, CHUNKS, FIGURES)
def visible_totals(spark, d):
    """What a reader can see of five relations, in one row."""
    s = sources(spark, d)
    c = acl.secured(chunks(spark, d), s, WHO)
    return reports.totals({"n_sources": acl.allowed_sources(s, WHO), "n_chunks": c, "n_documents": c.select("document").distinct(), "n_pages": c.select("document", "page").distinct(), "n_figures": acl.secured(figures(spark, d), s, WHO)})


QUESTIONS = "questions AS (SELECT item_id AS question, text FROM benchmark)"
RANKED = rf"""qw AS (SELECT DISTINCT question, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM questions),
cw AS (SELECT DISTINCT id, unnest({WORDS}) AS word FROM chunks), cdf AS (SELECT word, count(*) AS n FROM cw GROUP BY word),
cweights AS (SELECT word, ln((SELECT count(*) FROM chunks) / n) AS w FROM cdf WHERE n <= (SELECT count(*) FROM chunks) // {{divisor}}),
ranked AS (SELECT r.*, c.document, c.page, contains(lower(c.content), lower(substr(q.text, 1, 40))) AS good FROM
 (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM (SELECT question, id, round(sum(w), 6) AS score FROM qw JOIN cw USING (word) JOIN cweights USING (word) GROUP BY 1, 2)) r
 JOIN chunks c USING (id) JOIN questions q USING (question) WHERE r.rank <= 30)"""
NARROW = RANKED.replace("ranked AS", "narrow AS").replace("qw AS", "qn AS").replace("FROM qw", "FROM qn").replace("cw AS", "cn AS").replace("cw ", "cn ").replace("cdf", "cdn").replace("cweights", "cwn")


def _ranked(spark, d, divisor=20, n_words=None):
    """The 30 best chunks of each benchmark question by its rare words; good ones hold the question's beginning."""
    c = chunks(spark, d)
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    asked = q if n_words is None else q.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, n_words), " "))
    index = postings(spark, d)
    rows = retrieval.lexical_batch(None, index.frequencies(), index.total(), asked, 30, divisor, index)
    rows = rows.join(c.select("id", "document", "page", "content"), "id").join(q, "question")
    return rows.withColumn("good", F.contains(F.lower("content"), F.lower(F.substring("text", 1, 40)))).drop("content", "text")


@query("SELECT question, min(CASE WHEN good THEN rank END) AS position, coalesce(min(CASE WHEN good THEN rank END) <= 8, false) AS hit FROM ranked GROUP BY question", CHUNKS, QUESTIONS, RANKED.replace("{divisor}", "20"))
def hit_at_eight(spark, d):
    """First hits of the benchmark's questions."""
    return evaluation.first_hits(_ranked(spark, d), F.col("good"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN coalesce(b.hit, false) AND NOT coalesce(a.hit, false) THEN 'recovered' WHEN coalesce(a.hit, false) AND NOT coalesce(b.hit, false) THEN 'lost' ELSE 'same' END AS outcome FROM (SELECT question, coalesce(min(CASE WHEN good THEN rank END) <= 8, false) AS hit FROM ranked GROUP BY question) a FULL JOIN (SELECT question, coalesce(min(CASE WHEN good THEN rank END) <= 8, false) AS hit FROM narrow GROUP BY question) b ON a.question = b.question) GROUP BY outcome", CHUNKS, QUESTIONS, RANKED.replace("{divisor}", "20"), NARROW.replace("{divisor}", "200"))
def configurations_compared(spark, d):
    """Questions recovered and lost where fewer words count as rare."""
    return evaluation.compared(evaluation.first_hits(_ranked(spark, d), F.col("good")), evaluation.first_hits(_ranked(spark, d, 200), F.col("good")))


@query("SELECT question, round(max(distance) FILTER (WHERE rank = 50) - max(distance) FILTER (WHERE rank = 1), 6) AS band FROM (SELECT 0 AS question, distance, rank FROM vec) GROUP BY question", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 50))
def distance_band(spark, d):
    """How far the fiftieth row is from the first."""
    return evaluation.band(vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 50).withColumn("question", F.lit(0)))


def _form_sql(name, n):
    """``ranked`` of questions cut to their first words, under names of their own."""
    sql = RANKED.replace("FROM questions)", f"FROM (SELECT question, array_to_string(string_split(text, ' ')[1:{n}], ' ') AS text FROM questions))") if n else RANKED
    for x in ("qw", "cw", "cdf", "cweights", "ranked"):
        sql = re.sub(rf"\b{x}\b", f"{name}_{x}", sql)
    return sql.replace("{divisor}", "20")


FORMS = (("bare", 4), ("sentence", 10), ("natural", None))


@query(" UNION ALL ".join(f"SELECT '{f}' AS form, count(*) AS n, count(*) FILTER (WHERE hit) AS found FROM (SELECT coalesce(min(CASE WHEN good THEN rank END) <= 8, false) AS hit FROM {f}_ranked GROUP BY question)" for f, _ in FORMS), CHUNKS, QUESTIONS, *[_form_sql(f, n) for f, n in FORMS])
def question_forms(spark, d):
    """Hits by the form of a question: its first words, more of them, all."""
    out = None
    for form, n in FORMS:
        part = evaluation.first_hits(_ranked(spark, d, n_words=n), F.col("good")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found")).select(F.lit(form).alias("form"), "n", "found")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT quality, count(*) AS shown, count(*) FILTER (WHERE toxic = 0) AS relevant, round(count(*) FILTER (WHERE toxic = 0) / count(*), 6) AS share FROM labels GROUP BY quality")
def shown_precision(spark, d):
    """Share of shown rows that are relevant."""
    rows = read(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("toxic") == 0).alias("relevant"))
    return rows.withColumn("share", F.round(F.col("relevant") / F.col("shown"), 6))


@query("SELECT c.lang, count(*) AS rows, count(*) FILTER (WHERE v.rank <= 50) AS near FROM vec v JOIN chunks c ON c.id = v.id GROUP BY c.lang", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 200))
def strategy_rows(spark, d):
    """Rows of expected documents among the nearest, by strategy."""
    rows = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 200)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rank") <= 50).alias("near"))


@query("SELECT lang, count(*) AS n_chunks, count(e.vec_id) AS n_vectors FROM chunks LEFT JOIN embeddings e ON e.vec_id = id GROUP BY lang", CHUNKS)
def reader_comparison(spark, d):
    """Chunks and vectors of each reader."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("v"))
    return chunks(spark, d).join(e, "id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("v").alias("n_vectors"))


@query("SELECT event_type AS case_name, count(*) AS runs, count(*) FILTER (WHERE user_id % 9 = 0) AS lost, round(median(value) FILTER (WHERE user_id % 9 <> 0), 4) AS median_s, round(avg(value) FILTER (WHERE user_id % 9 <> 0), 4) AS mean_s, count(*) FILTER (WHERE user_id % 9 <> 0 AND value > 50) AS good FROM events GROUP BY 1")
def bench_summary(spark, d):
    """Medians and success of repeated runs; lost ones apart."""
    rows = read(spark, d, "events").select(F.col("event_type").alias("case"), F.col("value").alias("seconds"), (F.col("user_id") % 9 == 0).alias("lost"), (F.col("value") > 50).alias("good"))
    return evaluation.run_summary(rows).withColumnRenamed("case", "case_name")


@query("SELECT id, CAST(contains(p, ' the ') AS INTEGER) + CAST(contains(p, 'ecole') AS INTEGER) + CAST(contains(p, 'elle') AS INTEGER) AS n FROM (SELECT id, trim(regexp_replace(translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS p FROM (SELECT id, content FROM chunks))".replace("' the '", "'the'"), CHUNKS)
def answer_markers(spark, d):
    """Expected markers in a text, accents and case aside."""
    markers = F.array(F.lit("The"), F.lit("École"), F.lit("Ellé"))
    return chunks(spark, d).select("id", F.size(evaluation.markers_found(F.col("content"), markers)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1,7' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS cited FROM orders")
def cited_rows(spark, d):
    """Numbers in double brackets, each once."""
    n = (F.col("o_orderkey") % 50).cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, "see [[7]] and [[1]], [[7]] [9]").otherwise(F.concat(F.lit("so [["), n, F.lit("]].")))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(evaluation.cited_numbers(t), lambda x: x.cast("string")), ",").alias("cited"))


@query(f"SELECT lang, round(avg(share), 6) AS share FROM (SELECT lang, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}{{4,}}'))) / len(w) ELSE 0 END AS share FROM (SELECT lang, list_filter(regexp_split_to_array(content, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM chunks)) GROUP BY lang", CHUNKS)
def prose_share(spark, d):
    """Share of prose words by language."""
    return chunks(spark, d).groupBy("lang").agg(F.round(F.avg(text.prose_share(F.col("content"))), 6).alias("share"))


@query("SELECT question, count(*) FILTER (WHERE rank <= 10) AS named, count(*) FILTER (WHERE rank <= 10 AND good) AS right_ones FROM ranked GROUP BY question", CHUNKS, QUESTIONS, RANKED.replace("{divisor}", "20"))
def context_precision(spark, d):
    """Right documents among those a context names."""
    return _ranked(spark, d).groupBy("question").agg(F.count_if(F.col("rank") <= 10).alias("named"), F.count_if((F.col("rank") <= 10) & F.col("good")).alias("right_ones"))


@query("SELECT position, count(*) AS n, bool_or(now) AS now, bool_or(exact) AS exact, bool_or(page) AS page FROM (SELECT question, min(CASE WHEN good THEN rank END) AS position, coalesce(min(CASE WHEN good THEN rank END) <= 8, false) AS now, bool_or(good) AS exact, coalesce(list_has_any(list(document) FILTER (WHERE rank <= 8), list(document) FILTER (WHERE good)), false) AS page FROM ranked GROUP BY question) GROUP BY position", CHUNKS, QUESTIONS, RANKED.replace("{divisor}", "20"))
def tool_gain(spark, d):
    """Questions found among the best, among all candidates, and in a document of the best, by first position."""
    found = F.collect_set(F.when(F.col("rank") <= 8, F.col("document")))
    per = _ranked(spark, d).groupBy("question").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("position"), F.bool_or("good").alias("exact"), F.arrays_overlap(found, F.collect_set(F.when(F.col("good"), F.col("document")))).alias("page"))
    per = per.withColumn("now", F.coalesce(F.col("position") <= 8, F.lit(False)))
    return per.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.bool_or("now").alias("now"), F.bool_or("exact").alias("exact"), F.bool_or("page").alias("page"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    """Extension: events in tumbling windows (the streaming form is in ``streaming``)."""
    rows = read(spark, d, "events").groupBy(F.window(F.col("ts"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", F.col("window.start").alias("start"), "n")


@query("SELECT id, document, page FROM chunks WHERE NOT EXISTS (SELECT 1 FROM embeddings e JOIN chunks c ON c.id = e.vec_id WHERE c.document = chunks.document AND c.page IS NOT DISTINCT FROM chunks.page)", CHUNKS)
def open_worklist(spark, d):
    """Chunks of pages of which no chunk has a vector yet."""
    return ingest.worklist(chunks(spark, d).select("id", "document", "page"), with_vectors(spark, d), ["document", "page"])


TITLES = "titles AS (SELECT document, page, max('T ' || id) AS title FROM chunks WHERE id % 2 = 0 GROUP BY document, page)"


@query(r"SELECT f.id, CASE WHEN t.title IS NULL THEN '' ELSE t.title || ' | ' END || 'Image: ' || trim(regexp_replace(f.description, '[ \t\n\r\f\v]+', ' ', 'g')) AS piece FROM figures f LEFT JOIN titles t ON t.document = f.document AND t.page IS NOT DISTINCT FROM f.page WHERE trim(regexp_replace(f.description, '[ \t\n\r\f\v]+', ' ', 'g')) <> '' AND f.label % 4 <> 1", CHUNKS, FIGURES, TITLES)
def figure_pieces(spark, d):
    """Descriptions of figures as pieces of text behind their page's title; decoration is left out."""
    titles = chunks(spark, d).where("id % 2 = 0").groupBy("document", "page").agg(F.max(F.concat(F.lit("T "), F.col("id").cast("string"))).alias("title"))
    verdict = F.when(F.col("label") % 4 == 1, F.lit("\nVerdict: decoration")).otherwise(F.lit(""))
    return ingest.figure_pieces(figures(spark, d).withColumn("description", F.concat("description", verdict)), titles).select("id", "piece")


@query("SELECT document, row_number() OVER (PARTITION BY document ORDER BY ord) AS nth, line FROM (SELECT document, substr(first, 1, 120) AS line, min(ord) AS ord FROM (SELECT document, id AS ord, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '|'))[1] AS first FROM chunks) WHERE first IS NOT NULL GROUP BY 1, 2)", CHUNKS)
def heading_sample(spark, d):
    """First lines of a document's pieces, each once."""
    out = ingest.heading_sample(chunks(spark, d).select("document", F.col("id").alias("ord"), F.col("content").alias("piece")))
    return out.withColumn("nth", F.col("nth").cast("long"))


@query("SELECT document, page, substr(string_agg(content, chr(10) ORDER BY id), 1, 2500) AS text FROM chunks GROUP BY document, page", CHUNKS)
def page_texts(spark, d):
    """Text of each page from its pieces, cut to 2,500 characters."""
    return ingest.page_texts(chunks(spark, d).select("document", "page", F.col("id").alias("ord"), F.col("content").alias("piece")))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY p_brand) // 12) AS step FROM part) WHERE i % step = 0 AND i // step < 12")
def stride_sample(spark, d):
    """At most twelve evenly spaced codes of each brand."""
    return ingest.stride_sample(read(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query("SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN next_turn END AS resume FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS total, row_number() OVER w AS nth, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE total <= 1500 OR nth = 1")
def budget_resume(spark, d):
    """Rows within a text budget, and where to go on."""
    return reports.within_budget(read(spark, d, "conversations"), "conv_id", "turn", "text", 1500).select("conv_id", "turn", "resume")

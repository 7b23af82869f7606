"""Queries on headings, patterns, stems and the log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import stems
from tessera.operators import bounds, headings
from tessera.operators.postings import Postings
from tessera.sources import audit
from tessera.sources.generations import work_dir

from .base import chunks, query, read


def _catalogue(spark, d):
    """Customers and suppliers as the Markdown catalogue of each nation: a page for each market segment, one for suppliers."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("k"), F.concat("c_name", F.lit("\n"), F.col("c_custkey").cast("string")).alias("entry"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("zz").alias("part"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("entry"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]), "\n\n")
    pages = c.unionByName(s).groupBy("n_nationkey", "part").agg(entries.alias("entries"))
    # the first page of a nation opens with its region and name; suppliers have a heading of the nation's rank
    pages = pages.join(n, "n_nationkey").withColumn("page", F.row_number().over(Window.partitionBy("n_nationkey").orderBy("part")))
    title = F.when(F.col("part") == "zz", "## Suppliers").otherwise(F.concat(F.lit("### "), F.col("part"), F.lit(" ###")))
    head = F.when(F.col("page") == 1, F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n## "), F.col("n_name"), F.lit("\n"))).otherwise("")
    return pages.select(F.col("n_name").alias("document"), "page", F.concat(head, title, F.lit("\n"), F.col("entries"), F.lit("\n")).alias("markdown"))


@query("""SELECT n_name AS document, page, r_name || ' > ' || CASE WHEN part = 'zz' THEN 'Suppliers' ELSE n_name || ' > ' || part END AS path, entry AS text FROM (
 SELECT n_name, r_name, part, entry, dense_rank() OVER (PARTITION BY n_nationkey ORDER BY part) AS page FROM nation JOIN region ON r_regionkey = n_regionkey JOIN
 (SELECT c_nationkey AS k, c_mktsegment AS part, c_name || chr(10) || c_custkey AS entry FROM customer UNION ALL SELECT s_nationkey, 'zz', s_name FROM supplier) e ON e.k = n_nationkey)""")
def heading_paths(spark, d):
    """Blocks of a catalogue's pages under the path of their headings, over page ends."""
    return headings.heading_blocks(_catalogue(spark, d)).select("document", F.col("page").cast("long").alias("page"), "path", "text")


_BLOCK_TAGS = "p|li|ul|ol|div|section|article|nav|header|footer|main|aside|table|tr|td|th|pre|blockquote|br|hr|body|html"


@query(rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<head[ >].*?</head>', '', 'g'), '(?is)<script[ >].*?</script>', '', 'g'), '(?is)<style[ >].*?</style>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)<h1[^>]*>', chr(10) || '# ', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)</?(h1|{_BLOCK_TAGS})(>|[ /][^>]*>)', chr(10), 'g') AS h FROM t),
c AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10)) AS h FROM m),
l AS (SELECT page_id, unnest(h) AS line, generate_subscripts(h, 1) AS pos FROM c),
p AS (SELECT *, last_value(CASE WHEN line LIKE '# _%' THEN trim(substr(line, 3)) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM l)
SELECT page_id, coalesce(path, '') AS path, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM p WHERE trim(line) <> '' AND line NOT LIKE '# _%' GROUP BY 1, 2""")
def page_headings(spark, d):
    """Web pages as Markdown blocks under their headings: blocks and characters of each path."""
    pages = read(spark, d, "pages").select(F.col("page_id").alias("document"), F.lit(None).cast("int").alias("page"), headings.html_to_markdown(F.col("html")).alias("markdown"))
    rows = headings.heading_blocks(pages).groupBy(F.col("document").alias("page_id"), "path")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("""SELECT p_partkey, list_aggregate(list_transform(list_filter(a, lambda x: contains(trim(x), ' ')), lambda x: trim(x)), 'string_agg', ';') AS refused, list_aggregate(list_filter(a, lambda x: trim(x) <> '' AND NOT contains(trim(x), ' ')), 'string_agg', '|') AS cleaned
 FROM (SELECT p_partkey, string_split(p_type || '|' || replace(p_brand, '#', ' ') || '| ' || lower(substr(p_name, 1, 5)) || '||' || CASE WHEN p_size > 25 THEN 'oak' ELSE 'white oak' END, '|') AS a FROM part)""")
def pattern_refusals(spark, d):
    """Alternatives of a pattern that hold a space, and the pattern without them."""
    pattern = F.concat_ws("|", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" ")), F.concat(F.lit(" "), F.lower(F.substring("p_name", 1, 5))), F.lit(""), F.when(F.col("p_size") > 25, "oak").otherwise("white oak"))
    rows = read(spark, d, "part").withColumn("pattern", pattern)
    refused = F.array_join(bounds.refused_alternatives(F.col("pattern")), ";")
    return rows.select("p_partkey", F.nullif(refused, F.lit("")).alias("refused"), bounds.cleaned_pattern(F.col("pattern")).alias("cleaned"))


@query("""WITH RECURSIVE hashed AS (SELECT strftime(ts, '%Y%m%d') AS batch, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events),
sums AS (SELECT batch, count(*) || ',' || sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) || ',' || sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) || ',' || sum(CAST('0x' || substr(h, 33, 16) AS UBIGINT)) || ',' || sum(CAST('0x' || substr(h, 49, 16) AS UBIGINT)) AS t FROM hashed GROUP BY batch),
numbered AS (SELECT batch, sha256(t) AS digest, row_number() OVER (ORDER BY batch) AS k FROM sums),
chain AS (SELECT batch, digest, k, sha256(digest) AS link FROM numbered WHERE k = 1 UNION ALL SELECT n.batch, n.digest, n.k, sha256(c.link || n.digest) FROM chain c JOIN numbered n ON n.k = c.k + 1)
SELECT CAST(batch AS BIGINT) AS batch, digest, link FROM chain""")
def audit_chain(spark, d):
    """Events as daily batches of a log: each day's digest, and the chain over them."""
    rows = read(spark, d, "events").select(F.date_format("ts", "yyyyMMdd").cast("long").alias("batch"), "event_id", "event_type", "user_id")
    found = audit.batch_digests(rows, ["event_id", "event_type", "user_id"])
    chain = audit.links([(r["batch"], r["digest"]) for r in found.select("batch", "digest").collect()])  # a row a day
    return found.select("batch", "digest").join(spark.createDataFrame(chain, "batch long, link string"), "batch")


@query()
def stemmed_frequencies(spark, d):
    """In how many passages each Italian stem occurs, from postings of stems."""
    index = Postings(spark, f"{work_dir(spark)}/stems-{uuid.uuid4().hex}", lambda words: words)
    c = chunks(spark, d)
    index.update(None, stems.stemmed(c), c.count())
    return index.frequencies()

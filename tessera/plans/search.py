"""Access control and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import acl, text, vectors
from tessera.operators import ingest, retrieval

from .base import ALLOWED, CHUNKS, FIGURES, GROUPS, QUERY_VECTOR, SOURCES, TERMS, VECTORS, WHO, WORDS, chunks, figures, postings, query, query_vector, read, sources, with_vectors

DIVISOR = 20
TERM_SQL = "terms AS (SELECT unnest(['trash', 'pathetic', 'worthless', 'the']) AS word)"
DF_SQL = f"df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest({WORDS}) AS word FROM chunks) GROUP BY word)"
WEIGHT_SQL = f"weights AS (SELECT t.word, ln((SELECT count(*) FROM chunks) / coalesce(df.n, 1)) AS w, coalesce(df.n, 1) <= (SELECT count(*) FROM chunks) // {DIVISOR} AS rare FROM terms t LEFT JOIN df USING (word))"


def _lexical_sql(name: str, pool: str, k: int, gate: str = "rare") -> str:
    return f"""{name}_w AS (SELECT DISTINCT id, unnest({WORDS}) AS word FROM {pool}),
{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum(w), 6) AS score FROM {name}_w JOIN weights USING (word) GROUP BY id HAVING bool_or({gate})) ORDER BY score DESC, id LIMIT {k})"""


VISIBLE = "visible AS (SELECT * FROM chunks WHERE source_id IN (SELECT id FROM allowed))"
VISIBLE_V = "visible_v AS (SELECT v.* FROM vectors v WHERE source_id IN (SELECT id FROM allowed))"


def _nearest_sql(name: str, pool: str, k: int) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT id, round(list_cosine_distance(embedding, {QUERY_VECTOR}), 6) AS distance FROM {pool}) WHERE distance IS NOT NULL ORDER BY distance, id LIMIT {k})"""


FUSED = "fused AS (SELECT id, round(sum(1 / (60.0 + rank)), 6) AS points FROM (SELECT id, rank FROM vec UNION ALL SELECT id, rank FROM lex) GROUP BY id ORDER BY points DESC, id LIMIT {n})"


@query(f"SELECT f.id, v.document, v.page, f.points FROM fused f JOIN visible v ON v.id = f.id", SOURCES, ALLOWED, CHUNKS, VECTORS, VISIBLE, VISIBLE_V, TERM_SQL, DF_SQL, WEIGHT_SQL, _nearest_sql("vec", "visible_v", 30), _lexical_sql("lex", "visible", 30), FUSED.format(n=8))
def retrieval_hybrid(spark, d):
    """Vector and rare-word branches fused by rank, access filtered below both."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows, _ = retrieval.indexed_search(chunks(spark, d).join(e, "id", "left"), sources(spark, d), postings(spark, d), WHO, TERMS, query_vector(spark, d), divisor=DIVISOR)
    return rows.select("id", "document", "page", "points")


@query("SELECT f.id, f.points FROM fused f", SOURCES, ALLOWED, CHUNKS, "visible AS (SELECT * FROM chunks WHERE source_id IN (SELECT id FROM allowed) AND regexp_matches(content, '(?i)clown'))", "vectors AS (SELECT v.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM visible v JOIN embeddings e ON e.vec_id = v.id)", TERM_SQL, DF_SQL, WEIGHT_SQL, _nearest_sql("vec", "vectors", 30), _lexical_sql("lex", "visible", 30), FUSED.format(n=8))
def retrieval_must_match(spark, d):
    """Both branches restricted to chunks that match a pattern."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows, _ = retrieval.indexed_search(chunks(spark, d).join(e, "id", "left"), sources(spark, d), postings(spark, d), WHO, TERMS, query_vector(spark, d), pattern="(?i)clown", divisor=DIVISOR)
    return rows.select("id", "points")


@query(
    "SELECT 'clown' AS wanted, true AS kept, id, points FROM fused_m UNION ALL SELECT 'no such passage', EXISTS (SELECT 1 FROM visible WHERE regexp_matches(content, '(?i)no such passage')), id, points FROM fused",
    SOURCES, ALLOWED, CHUNKS, VECTORS, VISIBLE, VISIBLE_V, TERM_SQL, DF_SQL, WEIGHT_SQL, "met AS (SELECT * FROM visible WHERE regexp_matches(content, '(?i)clown'))", "met_v AS (SELECT * FROM visible_v WHERE regexp_matches(content, '(?i)clown'))",
    _nearest_sql("vec", "visible_v", 30), _lexical_sql("lex", "visible", 30), _nearest_sql("vec_m", "met_v", 30), _lexical_sql("lex_m", "met", 30), FUSED.format(n=8), FUSED.format(n=8).replace("fused", "fused_m").replace("FROM vec", "FROM vec_m").replace("FROM lex", "FROM lex_m"),
)
def retrieval_soft_constraint(spark, d):
    """A pattern that visible chunks match, and one that none does: the search runs without it and says so."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pool, found = chunks(spark, d).join(e, "id", "left"), []
    for wanted in ("clown", "no such passage"):
        rows, _ = retrieval.indexed_search(pool, sources(spark, d), postings(spark, d), WHO, TERMS, query_vector(spark, d), pattern=f"(?i){wanted}", divisor=DIVISOR)
        _, kept = retrieval.constrained(acl.secured(pool, sources(spark, d), WHO), f"(?i){wanted}")
        found.append(rows.select(F.lit(wanted).alias("wanted"), F.lit(kept).alias("kept"), "id", "points"))
    return found[0].unionByName(found[1])


@query("SELECT id, round(sum(1 / (60.0 + rank)), 6) AS points FROM lex GROUP BY id ORDER BY points DESC, id LIMIT 8", SOURCES, ALLOWED, CHUNKS, "visible AS (SELECT * FROM chunks WHERE source_id IN (SELECT id FROM allowed) AND document IN ('doc0', 'doc1', 'doc2', 'doc3'))", TERM_SQL, DF_SQL, WEIGHT_SQL, _lexical_sql("lex", "visible", 30))
def retrieval_text_only_in_documents(spark, d):
    """No query vector: the word branch alone, inside named documents."""
    rows, degraded = retrieval.indexed_search(chunks(spark, d), sources(spark, d), postings(spark, d), WHO, TERMS, None, documents=["doc0", "doc1", "doc2", "doc3"], divisor=DIVISOR)
    assert degraded
    return rows.select("id", "points")


@query("SELECT id, distance, rank FROM vec", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 30))
def vector_topk(spark, d):
    """Exact nearest chunks by cosine distance."""
    return vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 30).select("id", "distance", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, score, rank FROM lex", CHUNKS, TERM_SQL, DF_SQL, WEIGHT_SQL, _lexical_sql("lex", "chunks", 30))
def lexical_rare(spark, d):
    """Chunks with a rare query word, by summed rarity."""
    return postings(spark, d).best(TERMS, 30, DIVISOR, chunks(spark, d)).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, score, rank FROM lex", CHUNKS, "terms AS (SELECT unnest(['the', 'and']) AS word)", DF_SQL, WEIGHT_SQL, _lexical_sql("lex", "chunks", 20, "true"))
def lexical_fallback(spark, d):
    """No rare word: all words select."""
    return postings(spark, d).best("the and", 20, DIVISOR, chunks(spark, d), fallback=True).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT word, CAST(n AS BIGINT) AS n_chunks FROM df", CHUNKS, DF_SQL)
def document_frequency(spark, d):
    """In how many chunks each word occurs."""
    return postings(spark, d).frequencies()


@query("SELECT id, array_to_string(acl_groups, ',') AS groups, array_to_string(companies, ',') AS companies FROM sources WHERE id IN (SELECT id FROM allowed)", SOURCES, ALLOWED)
def acl_allowed_sources(spark, d):
    """Sources that a reader may use."""
    return acl.allowed_sources(sources(spark, d), WHO).select("id", F.array_join("acl_groups", ",").alias("groups"), F.array_join("companies", ",").alias("companies"))


@query("SELECT source_id, count(*) AS n FROM chunks WHERE source_id IN (SELECT id FROM allowed) GROUP BY source_id", SOURCES, ALLOWED, CHUNKS)
def acl_secured_counts(spark, d):
    """Visible chunks of each source."""
    return acl.secured(chunks(spark, d), sources(spark, d), WHO).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, source_id FROM chunks WHERE false", CHUNKS)
def acl_no_identity(spark, d):
    """A reader without groups sees nothing."""
    return acl.secured(chunks(spark, d), sources(spark, d), acl.Principal.of([])).select("id", "source_id")


USERS = "users AS (SELECT * FROM (VALUES ('ann', true, ['all'], ['acme']), ('bob', true, ['tech'], ['borea']), ('cy', false, ['all', 'tech'], ['acme', 'borea']), ('di', true, ['board'], CAST([] AS VARCHAR[]))) t(user_name, enabled, groups, user_companies))"


def _users(spark):
    rows = [("ann", True, ["all"], ["acme"]), ("bob", True, ["tech"], ["borea"]), ("cy", False, ["all", "tech"], ["acme", "borea"]), ("di", True, ["board"], [])]
    return spark.createDataFrame(rows, "user string, enabled boolean, groups array<string>, user_companies array<string>")


@query("""SELECT user_name, id AS source_id, reason, reason = 'visible' AS sees FROM (SELECT user_name, id, CASE WHEN NOT enabled THEN 'user disabled' WHEN state <> 'active' THEN 'source ' || state
 WHEN NOT list_has_any(acl_groups, groups) THEN 'no common group' WHEN NOT list_has_any(companies, user_companies) THEN 'no common company' ELSE 'visible' END AS reason FROM users, sources)""", SOURCES, USERS)
def acl_visibility_explained(spark, d):
    """Who sees which source, and why not."""
    return acl.explained(_users(spark), sources(spark, d)).withColumnRenamed("user", "user_name")


@query("SELECT g AS group_name, string_agg(id, ',' ORDER BY id) AS sources, count(*) AS n FROM (SELECT id, unnest(acl_groups) AS g FROM sources) GROUP BY g", SOURCES)
def acl_group_usage(spark, d):
    """Sources that each group may read."""
    rows = sources(spark, d).select("id", F.explode("acl_groups").alias("group_name"))
    return rows.groupBy("group_name").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT g AS group_name, c AS company FROM (SELECT unnest(acl_groups) AS g, companies FROM sources WHERE state IN ('active', 'waiting')), LATERAL (SELECT unnest(companies) AS c)", SOURCES)
def acl_group_companies(spark, d):
    """Companies behind each group's active sources."""
    rows = sources(spark, d).where(F.col("state").isin("active", "waiting"))
    return rows.select(F.explode("acl_groups").alias("group_name"), "companies").select("group_name", F.explode("companies").alias("company")).distinct()


@query("SELECT id, len(list_filter(companies, lambda c: c <> 'acme')) = 0 AS editable FROM sources WHERE list_contains(companies, 'acme') OR len(companies) = 0", SOURCES)
def acl_editable_sources(spark, d):
    """Sources that an administrator sees and those they may change."""
    return acl.editable(sources(spark, d), ["acme"]).select("id", "editable")


@query("SELECT conv_id, turn, list_aggregate(list_sort(list_distinct(list_transform(list_filter([role, 'company-' || role, 'company-acme'], lambda x: starts_with(x, 'company-')), lambda x: substr(x, 9)))), 'string_agg', ',') AS companies FROM conversations")
def acl_companies_of_groups(spark, d):
    """Companies named by groups, each once."""
    rows = read(spark, d, "conversations")
    groups = F.array(F.col("role"), F.concat(F.lit("company-"), F.col("role")), F.lit("company-acme"))
    return rows.select("conv_id", "turn", F.array_join(acl.companies_column(groups), ",").alias("companies"))


PERMISSIONS = """roles AS (SELECT c_custkey AS user_name, c_acctbal > 5000 AS has_all, unnest([c_mktsegment, r_name]) AS role FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
matrix AS (SELECT r_name AS role, 'area' || n_nationkey % 4 AS area, CASE WHEN n_nationkey % 3 = 0 THEN 'M' ELSE 'L' END AS level, n_nationkey % 5 = 0 AS restricted FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT c_mktsegment, 'area' || length(c_mktsegment) % 4, CASE WHEN max(c_acctbal) > 9000 THEN 'M' ELSE 'L' END, false FROM customer GROUP BY c_mktsegment)"""


@query("SELECT user_name, area, CASE WHEN bool_or(level = 'M') THEN 'M' ELSE 'L' END AS level FROM roles JOIN matrix USING (role) WHERE NOT restricted OR has_all GROUP BY 1, 2", PERMISSIONS)
def acl_permissions(spark, d):
    """Areas of each user's roles: writing wins, areas tied to companies need all of them."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = read(spark, d, "customer")
    roles = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("user"), (F.col("c_acctbal") > 5000).alias("has_all"), F.array("c_mktsegment", "r_name").alias("roles"))
    k = F.col("n_nationkey")
    by_region = n.select(F.col("r_name").alias("role"), F.concat(F.lit("area"), (k % 4).cast("string")).alias("area"), F.when(k % 3 == 0, "M").otherwise("L").alias("level"), (k % 5 == 0).alias("restricted"))
    by_segment = c.groupBy(F.col("c_mktsegment").alias("role")).agg(F.concat(F.lit("area"), (F.length("role") % 4).cast("string")).alias("area"), F.when(F.max("c_acctbal") > 9000, "M").otherwise("L").alias("level"), F.lit(False).alias("restricted"))
    return acl.permissions(roles, by_region.unionByName(by_segment), F.col("has_all")).withColumnRenamed("user", "user_name")


@query("SELECT id, document, page FROM chunks WHERE source_id IN (SELECT id FROM allowed) AND (contains(lower(content), 'clown') OR page = 3) ORDER BY id LIMIT 40", SOURCES, ALLOWED, CHUNKS)
def guarded_select(spark, d):
    """An untrusted author's OR can't reach rows outside the access filter."""
    predicate = text.contains(F.col("content"), "clown") | (F.col("page") == 3)
    return retrieval.guarded_select(chunks(spark, d), sources(spark, d), WHO, ["document", "page"], {"document", "page", "content"}, predicate)


@query("SELECT count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunks WHERE source_id IN (SELECT id FROM allowed)", SOURCES, ALLOWED, CHUNKS)
def secure_view_sql(spark, d):
    """Plain SQL on access-filtered views."""
    own = acl.secure_session(spark, {"visible_chunks": lambda s: chunks(s, d)}, lambda s: sources(s, d), WHO)
    return own.sql("SELECT count(*) AS n, sum(length(content)) AS n_chars FROM visible_chunks")


@query("SELECT id, length(content) AS n_chars FROM chunks WHERE contains(lower(content), 'worthless') ORDER BY length(content), document, page NULLS LAST, id LIMIT 25", CHUNKS)
def exact_search(spark, d):
    """Literal containment, shortest first."""
    return retrieval.exact_search(chunks(spark, d), "Worthless", 25).select("id", F.length("content").cast("long").alias("n_chars"))


@query("SELECT source_id, document, count(*) AS n_chunks, min(page) AS first_page, max(page) AS last_page FROM chunks WHERE contains(lower(content), 'clown') GROUP BY source_id, document", CHUNKS)
def grep_documents(spark, d):
    """Documents that contain a term, with their pages."""
    return retrieval.documents_of(chunks(spark, d).where(text.contains(F.col("content"), "clown")))


@query("SELECT source_id, document, count(*) AS n_chunks, min(page) AS first_page, max(page) AS last_page FROM chunks GROUP BY source_id, document", CHUNKS)
def document_list(spark, d):
    """All documents with their pages."""
    return retrieval.documents_of(chunks(spark, d))


@query("SELECT id, content FROM chunks WHERE document = 'doc1' AND page IS NOT DISTINCT FROM NULL", CHUNKS)
def page_read(spark, d):
    """The chunks of a page, the page without a number here."""
    return retrieval.page_of(chunks(spark, d), "doc1", None).select("id", "content")


@query("SELECT c.id, coalesce(string_agg(f.id, ',' ORDER BY f.id), '') AS figure_ids FROM chunks c LEFT JOIN figures f ON f.source_id = c.source_id AND f.document = c.document AND f.page IS NOT DISTINCT FROM c.page GROUP BY c.id", CHUNKS, FIGURES)
def chunk_figures(spark, d):
    """Figures on each chunk's page; pages without a number match each other."""
    rows = retrieval.with_figures(chunks(spark, d), figures(spark, d))
    return rows.select("id", F.coalesce(F.array_join(F.transform("figure_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("figure_ids"))


FIGURE_SQL = f"scored AS (SELECT id, page, round(coalesce(list_sum(list_transform(list_filter([{{'t': 'the', 'w': 1.0}}, {{'t': 'clown', 'w': 4.0}}], lambda x: list_contains(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}]+'), x.t)), lambda x: x.w)), 0), 6) AS rarity, round(list_cosine_distance(embedding, {QUERY_VECTOR}), 6) AS distance FROM figures)"


@query("SELECT id, rarity, distance FROM scored WHERE page IN (1, 2, 3) ORDER BY rarity DESC, distance NULLS LAST, page NULLS LAST, id LIMIT 20", CHUNKS, FIGURES, FIGURE_SQL)
def figure_search(spark, d):
    """Figures of the answering pages by rarity, then distance."""
    return retrieval.figure_search(figures(spark, d), query_vector(spark, d), [("the", 1.0), ("clown", 4.0)], [1, 2, 3], 20).select("id", "rarity", "distance")


@query(r"SELECT id, n_terms FROM (SELECT id, page, CAST(regexp_matches(description, '(?i)\bthe\b') AS INTEGER) + CAST(regexp_matches(description, '(?i)\bwith\b') AS INTEGER) + CAST(regexp_matches(description, '(?i)\bstupid\b') AS INTEGER) AS n_terms FROM figures) WHERE n_terms > 0 ORDER BY n_terms DESC, page NULLS LAST, id LIMIT 30", CHUNKS, FIGURES)
def figure_words(spark, d):
    """Figures by how many whole words they hold."""
    return retrieval.figure_words(figures(spark, d), ["the", "with.", "Stupid"], 30).select("id", "n_terms")


@query("SELECT count(*) AS n FROM figures WHERE NOT regexp_matches(description, '(?i)logo|branding|customization|digital graphic|Susteren|##|qr code|barcode')", CHUNKS, FIGURES)
def figure_stop_filter(spark, d):
    """Figures that aren't marks or labels."""
    return figures(spark, d).where(~ingest.is_mark(F.col("description"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, distance FROM vec", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 8))
def neighbourhood(spark, d):
    """Nearest rows without a filter, for queries that found nothing."""
    return vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 8).select("id", "distance")


@query("SELECT id, level FROM (SELECT id, 'document' AS level FROM docs_top UNION ALL SELECT id, 'page' AS level FROM pages_top)", CHUNKS, VECTORS, "whole AS (SELECT * FROM vectors WHERE page IS NULL)", "paged AS (SELECT * FROM vectors WHERE page IS NOT NULL)", _nearest_sql("docs_top", "whole", 4), _nearest_sql("pages_top", "paged", 8))
def two_stage_index(spark, d):
    """Nearest document summaries and page summaries."""
    return retrieval.two_stage(with_vectors(spark, d), query_vector(spark, d), 4, 8).select("id", "level")


@query("SELECT v.id, v.rank, row_number() OVER (ORDER BY CASE WHEN v.id % 3 = 0 THEN v.id % 7 END NULLS LAST, -v.rank DESC, v.id) AS place FROM vec v", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 20))
def rerank_order(spark, d):
    """An outside order for some rows; the rest keeps its own."""
    rows = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 20).withColumn("points", -F.col("rank"))
    order = rows.where("id % 3 = 0").select("id", (F.col("id") % 7).alias("position"))
    out = retrieval.reranked(rows, order, 20)
    return out.select("id", F.col("rank").cast("long").alias("rank"), F.row_number().over(Window.orderBy(F.col("position").asc_nulls_last(), F.desc("points"), "id")).cast("long").alias("place"))


@query("SELECT id FROM (SELECT *, max(rarity) OVER () AS best, min(rarity) OVER () AS least FROM (SELECT * FROM scored ORDER BY distance, id LIMIT 50)) WHERE CASE WHEN best > 0 AND best > least THEN rarity = best ELSE true END ORDER BY distance NULLS LAST, id LIMIT 6", CHUNKS, FIGURES, FIGURE_SQL)
def figure_choice(spark, d):
    """Rows of the largest rarity where it tells rows apart."""
    f = figures(spark, d)
    rows = f.select("id", F.round(text.term_score(F.col("description"), [("the", 1.0), ("clown", 4.0)]), 6).alias("rarity"), F.round(vectors.cosine_distance(F.col("embedding"), vectors.vector(query_vector(spark, d))), 6).alias("distance"))
    return retrieval.discriminating(rows.orderBy("distance", "id").limit(50), 1e9, 6).select("id")


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY document, page ORDER BY distance, id) = 1 THEN 1 ELSE 2 END AS turn FROM (SELECT v.id, c.document, c.page, v.distance FROM vec v JOIN chunks c ON c.id = v.id)", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 60))
def spread_pages(spark, d):
    """One row of each page first."""
    rows = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 60)
    return retrieval.spread(rows, [F.col("distance"), F.col("id")]).select("id", "turn")


@query("SELECT '[' || rank || '] (' || document || ', ' || coalesce(CAST(page AS VARCHAR), '-') || ')' AS line FROM vec JOIN chunks USING (id)", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 15))
def context_lines(spark, d):
    """The numbered context of an answer."""
    rows = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 15)
    return rows.select(F.format_string("[%d] (%s, %s)", "rank", "document", F.coalesce(F.col("page").cast("string"), F.lit("-"))).alias("line"))


@query("SELECT document, page, string_agg(rank, ',' ORDER BY rank) AS numbers FROM vec JOIN chunks USING (id) GROUP BY document, page", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 60))
def citation_groups(spark, d):
    """A cited page once, with all its numbers."""
    rows = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 60).withColumnRenamed("rank", "number")
    return retrieval.cited_pages(rows).select("document", "page", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT DISTINCT string_split(path, '/')[-1] AS dataset FROM sources WHERE id IN (SELECT id FROM allowed)", SOURCES, ALLOWED)
def dataset_names(spark, d):
    """Last part of the paths a reader may use."""
    return acl.allowed_sources(sources(spark, d), WHO).select(F.element_at(F.split("path", "/"), -1).alias("dataset")).distinct()


@query("SELECT p_partkey FROM part WHERE CAST(round(p_retailprice, 2) AS DECIMAL(12, 2)) < 999.50 AND CAST(round(p_retailprice, 2) AS DECIMAL(12, 2)) >= 0")
def price_constraint(spark, d):
    """Texts with a price below a limit: the number is extracted and compared."""
    label = F.concat(F.lit("item at "), F.format_string("%.2f", F.round("p_retailprice", 2)), F.lit(" each"))
    return read(spark, d, "part").where(text.price_below(label, 999.5)).select("p_partkey")


@query("SELECT ref, value FROM (SELECT coalesce(n.ref, o.ref) AS ref, coalesce(n.value, o.value) AS value, o.ref AS op, n.ref AS np FROM (SELECT o_orderkey AS ref, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0) o FULL JOIN (SELECT o_orderkey AS ref, -o_totalprice AS value FROM orders WHERE o_orderkey % 4 = 0) n ON n.ref = o.ref) ORDER BY op NULLS LAST, np NULLS LAST LIMIT 60")
def merged_rows(spark, d):
    """New values at old positions, then further rows, capped."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("value"))
    return retrieval.merged_rows(o.where("ref % 3 = 0"), o.where("ref % 4 = 0").withColumn("value", -F.col("value")), 60).select("ref", "value")


@query("SELECT document, count(*) AS n, min(rank) AS best FROM vec JOIN chunks USING (id) GROUP BY document", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 1000000000))
def rank_diagnosis(spark, d):
    """Absolute ranks by distance of each document's rows."""
    rows = vectors.ranked(with_vectors(spark, d), query_vector(spark, d))
    return rows.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("rank").cast("long")).alias("best"))


@query(f"SELECT '{' '.join(['find clown', 'red'])}' AS q, '{'|'.join(['clown', 'stupid'])}' AS p, (SELECT count(*) FROM chunks WHERE regexp_matches(content, 'clown|stupid')) AS n", CHUNKS)
def query_expansion(spark, d):
    """Terms and values that a query lacks are appended; terms of one word make a pattern."""
    p = text.any_word(["clown", "two words", "stupid"])
    q = text.expanded_query("find clown", ["clown"], ["red", "red"])
    return chunks(spark, d).where(F.col("content").rlike(p)).agg(F.lit(q).alias("q"), F.lit(p).alias("p"), F.count(F.lit(1)).alias("n"))


@query("""SELECT a.p_partkey AS article, min(f.s_suppkey) AS figure FROM part a JOIN supplier f ON f.s_suppkey % 3 = a.p_size % 3 AND f.s_nationkey = a.p_partkey % 25 AND f.s_suppkey % 20 = (a.p_partkey // 100) % 20 AND f.s_suppkey % 7 = a.p_size % 7 GROUP BY 1""")
def article_figures(spark, d):
    """Figures of the same source, document and page that name an article's code."""
    text_of = lambda n: F.concat(F.lit("AB"), (F.col(n) % 7).cast("string"))
    source = lambda n: F.concat(F.lit("src"), (F.col(n) % 3).cast("string")).alias("source_id")
    articles = read(spark, d, "part").select(F.col("p_partkey").alias("id"), source("p_size"), (F.col("p_partkey") % 25).cast("string").alias("document"), (F.floor(F.col("p_partkey") / 100) % 20).cast("int").alias("page"), F.concat(F.lit("item "), text_of("p_size"), F.lit(", oak")).alias("content"))
    shown = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), source("s_suppkey"), F.col("s_nationkey").cast("string").alias("document"), (F.col("s_suppkey") % 20).cast("int").alias("page"), F.concat(F.lit("photo of "), text_of("s_suppkey")).alias("description"))
    return retrieval.article_figures(articles, shown)


@query("SELECT o_orderkey FROM orders WHERE ('doc' || (o_orderkey % 120), o_orderkey % 10) IN (SELECT (document, page) FROM chunks WHERE source_id IN (SELECT id FROM allowed) AND page IS NOT NULL)", SOURCES, ALLOWED, CHUNKS)
def valid_citations(spark, d):
    """Citations of pages that the reader may open."""
    mark = F.format_string("as said [doc%d, %d].", F.col("o_orderkey") % 120, F.col("o_orderkey") % 10)
    cited = read(spark, d, "orders").select("o_orderkey", mark.alias("t")).select("o_orderkey", F.regexp_extract("t", r"\[(doc\d+), (\d+)\]", 1).alias("document"), F.regexp_extract("t", r"\[(doc\d+), (\d+)\]", 2).cast("int").alias("page"))
    return retrieval.valid_citations(cited, acl.secured(chunks(spark, d), sources(spark, d), WHO)).select("o_orderkey")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS preceding FROM events")
def nearest_preceding(spark, d):
    """The last mention before each row."""
    rows = retrieval.nearest_preceding(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")))
    return rows.select("user_id", "event_id", "preceding")


@query("SELECT way, count(*) AS n, count(*) FILTER (WHERE c.lang = 'en') AS hits FROM (SELECT 'vector' AS way, id FROM vec WHERE rank <= 8 UNION ALL SELECT 'text', id FROM lex WHERE rank <= 8 UNION ALL SELECT 'fused', id FROM fused) JOIN chunks c USING (id) GROUP BY way", CHUNKS, VECTORS, TERM_SQL, DF_SQL, WEIGHT_SQL, _nearest_sql("vec", "vectors", 30), _lexical_sql("lex", "chunks", 30), FUSED.format(n=8))
def ablation(spark, d):
    """Hits of each branch alone and of both."""
    c = chunks(spark, d)
    vec = vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 30)
    lex = postings(spark, d).best(TERMS, 30, DIVISOR, c)
    both = retrieval.fused([vec, lex]).orderBy(F.desc("points"), "id").limit(8)
    ways = [("vector", vec.where("rank <= 8")), ("text", lex.where("rank <= 8")), ("fused", both)]
    rows = None
    for name, way in ways:
        part = way.select(F.lit(name).alias("way"), "id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(c.select("id", "lang"), "id").groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("hits"))


@query("SELECT CAST(len(embedding) AS INTEGER) AS dimensions, count(*) AS n FROM embeddings GROUP BY 1")
def index_canary(spark, d):
    """One dimension in the whole index, else writes are blocked."""
    ingest.one_dimension(read(spark, d, "embeddings"))
    return read(spark, d, "embeddings").groupBy(F.size("embedding").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def trace_rows(spark, d):
    """A row for each conversation with its turns in order."""
    turns = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",")
    return read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT e.event_id, f.event_type AS feedback FROM events e JOIN events f ON f.event_id = e.event_id + 1 AND f.event_type = 'click' WHERE e.event_type = 'view'")
def trace_feedback(spark, d):
    """Traces with the feedback on their message."""
    e = read(spark, d, "events")
    f = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("feedback"))
    return retrieval.with_feedback(e.where("event_type = 'view'").select("event_id"), f, "event_id")


@query("SELECT id FROM chunks WHERE lang IN ('de', 'fr') AND page = 4", CHUNKS)
def optional_filters(spark, d):
    """Filters that are given apply; those that are null don't exist."""
    return retrieval.filtered(chunks(spark, d), {"lang": ["de", "fr"], "page": [4], "document": None}).select("id")


@query("SELECT count(*) AS n FROM chunks WHERE source_id IN (SELECT id FROM allowed)", SOURCES, ALLOWED, CHUNKS)
def guard_refusals(spark, d):
    """An author's predicate on a column that isn't allowed is refused, whatever it would find; two readers keep views of their own."""
    c, s = chunks(spark, d), sources(spark, d)
    for hidden in (F.col("source_id") == "src0", c["source_id"] == "src0", F.col("lang") == "en", F.expr("length(source_id) > 0")):
        try:
            retrieval.guarded_select(c, s, WHO, ["document"], {"document", "page", "content"}, hidden)
        except ValueError:
            continue
        raise AssertionError("a hidden column was filtered")
    own = acl.secure_session(spark, {"mine": lambda x: chunks(x, d)}, lambda x: sources(x, d), WHO)
    acl.secure_session(spark, {"mine": lambda x: chunks(x, d)}, lambda x: sources(x, d), acl.Principal.of(["tech", "company-borea"]))
    return own.sql("SELECT count(*) AS n FROM mine")


@query("SELECT id, rarity, distance FROM scored WHERE id IN (SELECT id FROM figures WHERE source_id IN (SELECT id FROM allowed)) ORDER BY rarity DESC, distance NULLS LAST, page NULLS LAST, id LIMIT 20", SOURCES, ALLOWED, CHUNKS, FIGURES, FIGURE_SQL)
def figure_search_secured(spark, d):
    """Figures with a vector that a reader may see, by rarity, then distance."""
    return retrieval.secured_figure_search(figures(spark, d), sources(spark, d), WHO, query_vector(spark, d), [("the", 1.0), ("clown", 4.0)], None, 20).select("id", "rarity", "distance")


@query(r"SELECT id, n_terms FROM (SELECT id, page, document, CAST(regexp_matches(description, '(?i)\bthe\b') AS INTEGER) + CAST(regexp_matches(description, '(?i)\bwith\b') AS INTEGER) AS n_terms FROM figures WHERE page < 5) WHERE n_terms > 0 ORDER BY n_terms DESC, page NULLS LAST, id LIMIT 30", CHUNKS, "figures AS (SELECT e.vec_id AS id, c.document, c.page, c.content AS description FROM embeddings e JOIN chunks c ON c.id = e.vec_id WHERE c.document IN ('doc1', 'doc2', 'doc3', 'doc4', 'doc5'))".replace("description FROM", "description FROM"))
def figure_words_constrained(spark, d):
    """Words of figures in named documents; a constraint that nothing meets is given up."""
    f = figures(spark, d).where("page < 5")
    return retrieval.figure_words(f, ["the", "with."], 30, documents=["doc1", "doc2", "doc3", "doc4", "doc5"], pattern="no figure holds this").select("id", "n_terms")


@query("SELECT id, row_number() OVER (ORDER BY pos NULLS LAST, points DESC, id) AS place FROM (SELECT id, CASE WHEN id % 3 = 0 THEN id % 7 END AS pos, max(points) AS points FROM (SELECT id, -rank AS points FROM vec UNION ALL SELECT id, -rank FROM lex) GROUP BY id)", CHUNKS, VECTORS, TERM_SQL, DF_SQL, WEIGHT_SQL, _nearest_sql("vec", "vectors", 20), _lexical_sql("lex", "chunks", 20).replace("count(*)", "count(*)"))
def search_rounds(spark, d):
    """Rows of two rounds united by id, then in an outside order."""
    c = chunks(spark, d)
    best = lambda rows: rows.select("id", (-F.col("rank")).alias("points"))
    one = best(vectors.nearest(with_vectors(spark, d), query_vector(spark, d), 20))
    two = best(postings(spark, d).best(TERMS, 20, DIVISOR, c))
    order = c.where("id % 3 = 0").select("id", (F.col("id") % 7).alias("position"))
    rows = retrieval.rounds_united([one, two], order, 100)
    return rows.select("id", F.row_number().over(Window.orderBy(F.col("position").asc_nulls_last(), F.desc("points"), "id")).cast("long").alias("place"))


@query("SELECT id, false AS judged FROM vec", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 8))
def neighbours_of_nothing(spark, d):
    """A filter that finds nothing gives the nearest rows, marked as not judged."""
    c = with_vectors(spark, d)
    return retrieval.or_neighbours(c.where("content = 'no such text'"), c, query_vector(spark, d), 8).select("id", "judged")


@query(r"SELECT id, n_terms FROM (SELECT id, page, CAST(regexp_matches(description, '(?i)\bthe\b') AS INTEGER) + CAST(regexp_matches(description, '(?i)\bwith\b') AS INTEGER) AS n_terms FROM figures WHERE source_id IN (SELECT id FROM allowed) AND NOT regexp_matches(description, '(?i)logo|branding|customization|digital graphic|Susteren|##|qr code|barcode') AND regexp_matches(description, '(?i)clown|thing')) WHERE n_terms > 0 ORDER BY n_terms DESC, page NULLS LAST, id LIMIT 30", SOURCES, ALLOWED, CHUNKS, FIGURES)
def figure_words_secured(spark, d):
    """Words of figures that a reader may see, under a constraint that some of them meet."""
    return retrieval.secured_figure_words(figures(spark, d), sources(spark, d), WHO, ["the", "with."], 30, pattern="(?i)clown|thing").select("id", "n_terms")


@query("SELECT id, level FROM (SELECT id, 'document' AS level FROM docs_top UNION ALL SELECT id, 'page' AS level FROM pages_top)", SOURCES, ALLOWED, CHUNKS, VECTORS, "whole AS (SELECT * FROM vectors WHERE page IS NULL AND source_id IN (SELECT id FROM allowed))", "paged AS (SELECT * FROM vectors WHERE page IS NOT NULL AND source_id IN (SELECT id FROM allowed))", _nearest_sql("docs_top", "whole", 4), _nearest_sql("pages_top", "paged", 8))
def two_stage_secured(spark, d):
    """Nearest document and page summaries that a reader may see."""
    return retrieval.secured_two_stage(with_vectors(spark, d), sources(spark, d), WHO, query_vector(spark, d), 4, 8).select("id", "level")


@query("""SELECT 1 AS round, 'done' AS outcome, id, true AS judged FROM vectors WHERE contains(lower(content), 'clown') UNION ALL SELECT 2, 'repeated', NULL, NULL UNION ALL SELECT 3, 'refused', NULL, NULL
 UNION ALL SELECT 4, 'empty', id, false FROM vec""", CHUNKS, VECTORS, _nearest_sql("vec", "vectors", 8))
def search_outcomes(spark, d):
    """Four searches of a turn: one that finds rows, the same again, one that can't run, and one whose neighbourhood stands in."""
    c, turn, out = with_vectors(spark, d), retrieval.Rounds(), None
    near = lambda: vectors.nearest(c, query_vector(spark, d), 8).select("id")
    found = lambda term: lambda: c.where(text.contains(F.col("content"), term)).select("id")
    asked = [("content has clown", found("clown")), ("Content  has CLOWN;", found("clown")), ("no_column > 1", lambda: c.where("no_column > 1").select("id")), ("content has nothing", found("no such text"))]
    for n, (statement, make) in enumerate(asked, 1):
        rows, outcome = turn.run(statement, make, near)
        rows = spark.createDataFrame([(None, None)], "id long, judged boolean") if rows is None else rows.select("id", "judged")
        part = rows.select(F.lit(n).alias("round"), F.lit(outcome).alias("outcome"), "id", "judged")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR regexp_matches(text, '(?i)\\b(quali|quante|elenca|elencare|lista|tutt[ei]|assortimento|gamma|catalogo completo)\\b') OR turn % 5 = 1 THEN 120 ELSE 60 END AS pieces FROM conversations")
def pieces_by_intent(spark, d):
    """How many pieces each question needs: lists need more."""
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Quali colori? "), F.col("text"))).when(F.col("turn") % 5 == 1, F.concat(F.col("text"), F.lit(" che nastri avete"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", retrieval.pieces_wanted(asked).alias("pieces"))


@query("""SELECT p_partkey, 'Nei documenti a cui ho accesso non ho trovato ' || CASE p_partkey % 5 WHEN 0 THEN 'articoli che corrispondono alla tua richiesta' WHEN 1 THEN 'articoli di colore ' || p_brand || ', ' || p_size
 WHEN 2 THEN 'articoli della misura ' || p_size WHEN 3 THEN 'articoli con prezzo ' || p_size ELSE 'articoli con quelle caratteristiche' END || '.' AS said FROM part""")
def honest_empty(spark, d):
    """What is said where nothing was found, by the constraints of the search."""
    one = lambda a, v: F.struct(F.lit(a).alias("attribute"), v.cast("string").alias("value"))
    k, size, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    given = F.when(k % 5 == 1, F.array(one("colore", brand), one("misura", size))).when(k % 5 == 2, F.array(one("colore", F.lit("")), one("formato", size))).when(k % 5 == 3, F.array(one("prezzo", size))).when(k % 5 == 4, F.array(one("peso", F.lit(None))))
    return read(spark, d, "part").select("p_partkey", retrieval.nothing_found(given).alias("said"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM figures WHERE source_id IN (SELECT id FROM allowed))", SOURCES, ALLOWED, CHUNKS, FIGURES)
def visible_figures(spark, d):
    """Links to figures that a reader may still open."""
    links = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return retrieval.visible(links, figures(spark, d), sources(spark, d), WHO).select("o_orderkey")

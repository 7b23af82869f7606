"""Hybrid retrieval: vector and rare-word branches fused by rank, under access control."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import acl, text, vectors
from tessera.operators import ingest
from tessera.operators.postings import Postings

RRF_K, CANDIDATES, WIDE_CANDIDATES, DIVISOR = 60, 30, 150, 1000


def lexical_branch(chunks: DataFrame, frequencies: DataFrame, total: int, query: str, k: int, divisor: int = DIVISOR, fallback: bool = False) -> DataFrame:
    """The k chunks with a rare query word and the largest summed rarity of all query words in them."""
    weights, rare = text.term_weights(frequencies, text.analyse(query), total, divisor, fallback)
    if not rare:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    hits = chunks.where(F.arrays_overlap(text.words(F.col("content")), acl.literals(rare)))
    top = hits.withColumn("score", F.round(text.term_score(F.col("content"), weights), 6)).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def lexical_batch(chunks: DataFrame | None, frequencies: DataFrame, total: int, questions: DataFrame, k: int, divisor: int = DIVISOR, held: Postings | None = None) -> DataFrame:
    """The k best chunks (id, score, rank) of each of many questions (question, text) by summed rarity of shared rare words.

    One equality join on the word: a rare word is in total // divisor chunks at
    most, and only words of some question are kept before the join. ``held`` are
    stored postings, else the chunks' words are read.
    """
    weights = frequencies.where(F.col("n_chunks") <= total // divisor).select("word", F.log(F.lit(float(total)) / F.col("n_chunks")).alias("weight"))
    asked = questions.select("question", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word")).join(weights, "word")
    wanted = asked.select("word").distinct()
    if held is None:
        rows = chunks.select("id", F.explode(F.array_distinct(text.words(F.col("content")))).alias("word")).join(wanted, "word", "left_semi")
    else:
        rows = held.all_postings(wanted)
    scored = asked.join(rows, "word").groupBy("question", "id").agg(F.round(F.sum("weight"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rounds_united(rounds: list[DataFrame], order: DataFrame, limit: int) -> DataFrame:
    """Rows that several rounds of a search found, each id once (the first round's), in an outside scorer's order for the first question."""
    rows = None
    for i, found in enumerate(rounds):
        part = found.withColumn("round", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    whole = F.struct(*rows.columns)
    once = rows.groupBy("id").agg(F.min_by(whole, F.struct("round", -F.col("points"))).alias("r")).select("r.*")
    return reranked(once, order, limit)


def or_neighbours(rows: DataFrame, pool: DataFrame, query: list[float], k: int) -> DataFrame:
    """``rows`` as judged ones; where there are none, the k nearest of ``pool``, marked as not judged."""
    if not rows.isEmpty():
        return rows.withColumn("judged", F.lit(True))
    return vectors.nearest(pool, query, k).withColumn("judged", F.lit(False))


def filtered(rows: DataFrame, wanted: dict[str, list | None]) -> DataFrame:
    """Filters that are given apply; those that are None don't exist."""
    for column, values in wanted.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(values))
    return rows


def with_feedback(traces: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Traces that have a feedback on their message, with it."""
    return traces.join(feedback, key)


def fused(branches: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """id and points: the sum of 1 / (k + rank) over the branches that hold an id."""
    ranks = branches[0].select("id", "rank")
    for more in branches[1:]:
        ranks = ranks.unionByName(more.select("id", "rank"))
    return ranks.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("points"))


def hybrid_search(chunks: DataFrame, sources: DataFrame, frequencies: DataFrame, total: int, who: acl.Principal, query: str, vector: list[float] | None, limit: int = 8, pattern: str | None = None, documents: list[str] | None = None, candidates: int = CANDIDATES, divisor: int = DIVISOR) -> tuple[DataFrame, bool]:
    """The best chunks a reader may see, and whether the vector branch was missing.

    Filters stand below the top-k of each branch: access, documents, and the
    pattern a chunk must match. Wide columns are joined to the fused ids at the
    end. If nothing matches the pattern, the search runs again without it.
    """
    pool = _pool(chunks, sources, who, pattern, documents)
    return _combined(pool, lexical_branch(pool, frequencies, total, query, candidates, divisor), vector, limit, candidates)


def _pool(chunks: DataFrame, sources: DataFrame, who: acl.Principal, pattern: str | None, documents: list[str] | None) -> DataFrame:
    pool = acl.secured(chunks, sources, who)
    if documents is not None:
        pool = pool.where(F.col("document").isin(documents))
    return pool if pattern is None else constrained(pool, pattern)[0]


def constrained(pool: DataFrame, pattern: str) -> tuple[DataFrame, bool]:
    """Chunks that match a pattern, and that some do; where none does, all chunks, and that the constraint was dropped."""
    matching = pool.where(F.col("content").rlike(pattern))
    return (pool, False) if matching.isEmpty() else (matching, True)


def _combined(pool: DataFrame, lexical: DataFrame, vector: list[float] | None, limit: int, candidates: int) -> tuple[DataFrame, bool]:
    branches = [lexical] if vector is None else [vectors.nearest(pool, vector, candidates), lexical]
    best = fused(branches).orderBy(F.desc("points"), "id").limit(limit)
    return best.join(pool, "id"), vector is None


def indexed_search(chunks: DataFrame, sources: DataFrame, index: Postings, who: acl.Principal, query: str, vector: list[float] | None, limit: int = 8, pattern: str | None = None, documents: list[str] | None = None, candidates: int = CANDIDATES, divisor: int = DIVISOR) -> tuple[DataFrame, bool]:
    """``hybrid_search`` that reads the query's words from stored postings; texts are read for a pattern and for the answer only."""
    pool = _pool(chunks, sources, who, pattern, documents)
    return _combined(pool, index.best(query, candidates, divisor, pool), vector, limit, candidates)


def exact_search(chunks: DataFrame, term: str, limit: int) -> DataFrame:
    """Chunks that contain the term literally, shortest first."""
    return chunks.where(text.contains(F.col("content"), term)).orderBy(F.length("content"), F.col("document"), F.col("page").asc_nulls_last(), "id").limit(limit)


def documents_of(chunks: DataFrame) -> DataFrame:
    """Chunks and first and last page of each document."""
    return chunks.groupBy("source_id", "document").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def page_of(chunks: DataFrame, document: str, page: int | None) -> DataFrame:
    """A page's chunks; a null page is a page of its own."""
    return chunks.where((F.col("document") == document) & F.col("page").eqNullSafe(F.lit(page)))


def with_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Each chunk with the ids of figures on its page, in order."""
    ids = figures.groupBy("source_id", "document", "page").agg(F.array_sort(F.collect_list("id")).alias("figure_ids"))
    f = ids.select(F.col("source_id").alias("fs"), F.col("document").alias("fd"), F.col("page").alias("fp"), "figure_ids")
    same = (F.col("source_id") == F.col("fs")) & (F.col("document") == F.col("fd")) & F.col("page").eqNullSafe(F.col("fp"))
    return chunks.join(f, same, "left").drop("fs", "fd", "fp")


def figure_search(figures: DataFrame, query: list[float], terms: list[tuple[str, float]], pages: list[int] | None, limit: int) -> DataFrame:
    """Figures by rarity of matched words, then distance; without pages only figures with a vector count."""
    rows = figures.where(F.col("page").isin(pages)) if pages is not None else figures.where(F.col("embedding").isNotNull())
    rows = rows.withColumn("rarity", F.round(text.term_score(F.col("description"), terms), 6)).withColumn("distance", F.round(vectors.cosine_distance(F.col("embedding"), vectors.vector(query)), 6))
    return rows.orderBy(F.desc("rarity"), F.col("embedding").isNull(), F.col("distance").asc_nulls_last(), F.col("page").asc_nulls_last(), "id").limit(limit)


def secured_figure_search(figures: DataFrame, sources: DataFrame, who: acl.Principal, query: list[float], terms: list[tuple[str, float]], pages: list[int] | None, limit: int) -> DataFrame:
    """``figure_search`` over what a reader may see."""
    return figure_search(acl.secured(figures, sources, who), query, terms, pages, limit)


def visible(ids: DataFrame, rows: DataFrame, sources: DataFrame, who: acl.Principal, key: str = "id") -> DataFrame:
    """Those of ``ids`` that the reader may see now, whatever was allowed when they were handed out."""
    return ids.join(acl.secured(rows, sources, who).select(F.col(key)), key, "left_semi")


def secured_figure_words(figures: DataFrame, sources: DataFrame, who: acl.Principal, terms: list[str], limit: int, documents: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """``figure_words`` over figures that a reader may see, without marks and labels."""
    rows = acl.secured(figures, sources, who).where(~ingest.is_mark(F.col("description")))
    return figure_words(rows, terms, limit, documents, pattern)


def figure_words(figures: DataFrame, terms: list[str], limit: int, documents: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Figures by how many of the words their description holds.

    ``documents`` always holds; where no figure with a word matches ``pattern``,
    the search runs again without it.
    """
    hits = sum((F.col("description").rlike(text.whole_word(t)).cast("int") for t in terms), F.lit(0))
    if documents is not None:
        figures = figures.where(F.col("document").isin(documents))
    if pattern is not None:
        matching = figures.where(F.col("description").rlike(pattern))
        figures = figures if matching.where(hits > 0).isEmpty() else matching
    return figures.withColumn("n_terms", hits).where("n_terms > 0").orderBy(F.desc("n_terms"), F.col("page").asc_nulls_last(), "id").limit(limit)


def discriminating(rows: DataFrame, quota: float, cap: int) -> DataFrame:
    """Rows of the largest rarity if it tells rows apart, else those within ``quota`` of the best distance."""
    best, least, near = rows.agg(F.max("rarity"), F.min("rarity"), F.min("distance")).first()
    if best is not None and best > 0 and best > least:
        kept = F.col("rarity") == best
    else:
        kept = F.col("distance") <= F.lit(near) * (1 + quota)
    return rows.where(kept).orderBy(F.col("distance").asc_nulls_last(), "id").limit(cap)


def reranked(rows: DataFrame, order: DataFrame, limit: int) -> DataFrame:
    """Rows in an outside scorer's order (id, position); rows it doesn't know follow in their own."""
    known = order.groupBy("id").agg(F.min("position").alias("position"))
    return rows.join(known, "id", "left").orderBy(F.col("position").asc_nulls_last(), F.desc("points"), "id").limit(limit)


def spread(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First one row of each page, then the rest, both in order: adds ``turn`` (1 for firsts)."""
    nth = F.row_number().over(Window.partitionBy("document", "page").orderBy(*order))
    return rows.withColumn("turn", F.when(nth == 1, 1).otherwise(2))


def two_stage(summaries: DataFrame, query: list[float], n_documents: int, n_pages: int) -> DataFrame:
    """The nearest document summaries (no page), and the nearest page summaries."""
    whole = vectors.nearest(summaries.where("page is null"), query, n_documents).withColumn("level", F.lit("document"))
    return whole.unionByName(vectors.nearest(summaries.where("page is not null"), query, n_pages).withColumn("level", F.lit("page")))


def secured_two_stage(summaries: DataFrame, sources: DataFrame, who: acl.Principal, query: list[float], n_documents: int, n_pages: int) -> DataFrame:
    """``two_stage`` over summaries that a reader may see: access below both top-ks."""
    return two_stage(acl.secured(summaries, sources, who), query, n_documents, n_pages)


# Words of a question that asks for a list, and how many pieces answer it and any other.
LISTING = r"(?i)\b(quali|quante|elenca|elencare|lista|tutt[ei]|che\s+\w+\s+ci\s+sono|che\s+\w+\s+(avete|ci sono|esistono)|assortimento|gamma|catalogo completo)\b"
PIECES, PIECES_OF_A_LIST = 60, 120


def pieces_wanted(question: Column) -> Column:
    """How many pieces a question needs: more for one that asks for a list."""
    return F.when(F.coalesce(question, F.lit("")).rlike(LISTING), PIECES_OF_A_LIST).otherwise(PIECES)


# What is said where nothing was found, by the first attribute that a constraint names.
NOTHING = "Nei documenti a cui ho accesso non ho trovato {}."
NOTHING_OF = (("colore", "articoli di colore {}"), ("misura", "articoli della misura {}"), ("formato", "articoli della misura {}"), ("prezzo", "articoli con prezzo {}"))
NOTHING_ELSE, NO_VALUE, NO_CONSTRAINT = "articoli {}", "con quelle caratteristiche", "articoli che corrispondono alla tua richiesta"


def nothing_found(constraints: Column) -> Column:
    """The honest answer of a search that found nothing, for constraints (attribute, value)."""
    given = F.filter(constraints, lambda c: F.coalesce(c["value"], F.lit("")) != "")
    values = F.when(F.size(given) > 0, F.array_join(F.transform(given, lambda c: c["value"]), ", ")).otherwise(NO_VALUE)
    said = lambda form: F.concat(*[F.lit(part) if part != "{}" else values for part in re.split(r"(\{\})", form) if part])
    out = said(NOTHING_ELSE)
    named = F.transform(given, lambda c: c["attribute"])
    for attribute, form in reversed(NOTHING_OF):
        out = F.when(F.array_contains(named, attribute), said(form)).otherwise(out)
    begin, end = NOTHING.split("{}")
    some = F.size(F.coalesce(constraints, F.array())) > 0
    return F.concat(F.lit(begin), F.when(some, out).otherwise(NO_CONSTRAINT), F.lit(end))


class Rounds:
    """Searches of one turn: each tells whether it was refused, repeats an earlier one, found nothing, or was done.

    A search that found nothing gives its neighbourhood, as rows that nobody has
    judged; one that was refused has looked at nothing, and so gives none.
    """

    def __init__(self):
        self.seen: set[str] = set()

    def run(self, statement: str, make: Callable[[], DataFrame], near: Callable[[], DataFrame]) -> tuple[DataFrame | None, str]:
        said = " ".join(statement.split()).rstrip(";").lower()
        if not said:
            return None, "refused"
        if said in self.seen:
            return None, "repeated"
        try:
            rows = make()
            empty = rows.isEmpty()
        except (ValueError, PySparkException):
            return None, "refused"
        self.seen.add(said)
        if empty:
            return near().withColumn("judged", F.lit(False)), "empty"
        return rows.withColumn("judged", F.lit(True)), "done"


def cited_pages(context: DataFrame) -> DataFrame:
    """A page once, with the numbers of all its rows in the context."""
    return context.groupBy("document", "page").agg(F.array_sort(F.collect_list("number")).alias("numbers"))


def merged_rows(old: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """Old rows keep their position, new values win; further new rows follow; at most ``cap``."""
    both = old.select("ref", F.col("position").alias("old_position"), F.col("value").alias("old_value")).join(new.select("ref", F.col("position").alias("new_position"), F.col("value").alias("new_value")), "ref", "full")
    rows = both.select("ref", F.coalesce("new_value", "old_value").alias("value"), "old_position", "new_position")
    return rows.orderBy(F.col("old_position").asc_nulls_last(), F.col("new_position").asc_nulls_last(), "ref").limit(cap)


def guarded_select(table: DataFrame, sources: DataFrame, who: acl.Principal, columns: list[str], allowed: set[str], predicate: Column | None = None, limit: int = 40) -> DataFrame:
    """Rows for an untrusted author: one table, allow-listed columns, access filtered first, capped.

    The predicate meets only rows that passed the access filter, whatever its
    operators, and only allowed columns and the id: selecting or filtering by
    another column, source_id always among them, raises ValueError.
    """
    open_ = [c for c in table.columns if c in allowed and c != "source_id"]
    if refused := [c for c in columns if c not in open_]:
        raise ValueError(f"columns not allowed: {', '.join(refused)}")
    # behind an alias no name or column of the whole table can be found
    rows = acl.secured(table, sources, who).select("id", *[c for c in open_ if c != "id"]).alias("visible")
    if predicate is not None:
        try:
            rows = rows.where(predicate)
            rows.schema  # noqa: B018 (names are looked up now)
        except AnalysisException as e:
            raise ValueError(f"predicate not allowed: {e}") from None
    return rows.select("id", *columns).orderBy("id").limit(limit)


def article_figures(articles: DataFrame, figures: DataFrame) -> DataFrame:
    """The first figure on an article's page that names one of its codes: an equality join on source, document, page and code."""
    place = ("source_id", "document", "page")
    a = articles.select(F.col("id").alias("article"), *place, F.explode(text.codes(F.col("content"))).alias("code"))
    f = figures.select(F.col("id").alias("figure"), *[F.col(c).alias(f"f_{c}") for c in place], F.explode(text.codes(F.col("description"))).alias("f_code"))
    same = F.col("code") == F.col("f_code")
    for c in place:
        same &= F.col(c).eqNullSafe(F.col(f"f_{c}"))
    return a.join(f, same).groupBy("article").agg(F.min("figure").alias("figure"))


def valid_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited (document, page) pairs that a reader may open; others can't be told from ones that don't exist."""
    return citations.join(pages.select("document", "page").distinct(), ["document", "page"], "left_semi")


def nearest_preceding(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Each row with the last non-null ``value`` at or before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("preceding", F.last(value, ignorenulls=True).over(w))

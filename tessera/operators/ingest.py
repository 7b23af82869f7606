"""Ingestion: classes of files, incremental differences, duplicates, pieces and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import squeezed

# All Unicode spaces.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Formats by how they are read, and why some are not.
LAYOUT = ("pdf", "docx", "pptx", "html", "htm", "md", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
PLAIN, SHEETS = ("txt",), ("xlsx", "xlsm", "csv")
UNREADABLE = ("xls", "ods", "doc", "ppt")
EXTERNAL_ERRORS = "(?i)timeout|connection|unavailable|refused|reset"
RETRY_HOURS = 6
VERDICTS = ("information", "decoration", "table")
# What descriptions of marks, covers and labels hold.
MARKS = ("logo", "branding", "customization", "digital graphic", "Susteren", "##", "qr code", "barcode")


def readable_files(files: DataFrame) -> DataFrame:
    """Files to consider (no hidden, temporary or underscored part in their path) with extension and reader class."""
    name = F.element_at(F.split("path", "/"), -1)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("_") | p.startswith(".") | p.startswith("~$"))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ext.isin(*LAYOUT), "layout").when(ext.isin(*PLAIN), "text").when(ext.isin(*SHEETS), "sheet").when(ext.isin(*UNREADABLE), "excluded").otherwise("unknown")
    return files.where(~hidden).withColumn("ext", ext).withColumn("reader", kind).where("reader <> 'unknown'")


def differences(present: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state and old_path for a scan (path, size, mtime, hash) against what is known.

    unchanged (size and time), touched (content the same), changed, new, moved
    (content of a path that is gone from the scan; a copy is not a move),
    duplicate (content of a path that is still there), removed.
    """
    p = present.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("hash").alias("h"))
    k = manifest.select(F.col("path").alias("known"), F.col("size").alias("ks"), F.col("mtime").alias("km"), F.col("hash").alias("kh"))
    both = p.join(k, F.col("path") == F.col("known"), "full")
    gone = both.where("path is null").groupBy("kh").agg(F.min("known").alias("gone_path"))
    here = both.where("path is not null and known is not null").groupBy("kh").agg(F.min("known").alias("same_path")).withColumnRenamed("kh", "here_hash")
    fresh = both.where("known is null").select("path", "h").join(gone, F.col("h") == F.col("kh"), "left").join(here, F.col("h") == F.col("here_hash"), "left")
    # one arrival takes over a vanished path, the smallest; other copies are duplicates
    first = F.row_number().over(Window.partitionBy("h").orderBy("path")) == 1
    fresh = fresh.withColumn("first", first).select("path", F.when(F.col("gone_path").isNotNull() & F.col("first"), "moved").when(F.coalesce("same_path", "gone_path").isNotNull(), "duplicate").otherwise("new").alias("state"), F.when(F.col("first"), F.col("gone_path")).alias("old_path"))
    stay = both.where("path is not null and known is not null").select("path", F.when((F.col("s") == F.col("ks")) & (F.col("m") == F.col("km")), "unchanged").when(F.col("h") == F.col("kh"), "touched").otherwise("changed").alias("state"), F.lit(None).cast("string").alias("old_path"))
    moved = fresh.where("state = 'moved'").select(F.col("old_path").alias("moved_path"))
    removed = both.where("path is null").join(moved, F.col("known") == F.col("moved_path"), "left_anti").select(F.col("known").alias("path"), F.lit("removed").alias("state"), F.lit(None).cast("string").alias("old_path"))
    return stay.unionByName(fresh).unionByName(removed)


def emptied(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Sources with known documents of which a scan found none: blocked, as their folder may be unreachable."""
    found = present.select("source_id").distinct()
    return manifest.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_known")).join(found, "source_id", "left_anti")


def to_retry(state: Column, error: Column, hours_since: Column) -> Column:
    """Only errors from outside are tried again, and not more often than every six hours."""
    return F.coalesce((state == "error") & error.rlike(EXTERNAL_ERRORS) & (hours_since >= RETRY_HOURS), F.lit(False))


def duplicates(rows: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """Fingerprints of several documents: how many, and the smallest name; members follow by a join, not a list."""
    return rows.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")).where("n > 1")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each source, document, page and content; a null page equals a null page."""
    return chunks.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["source_id", "document", "page", "content_hash"])


def paragraphs(rows: DataFrame, text: str = "content") -> DataFrame:
    """Texts cut at blank lines: ord and piece, without empty ones."""
    return rows.select("*", F.posexplode(F.split(text, r"\n[ \t]*\n|\n")).alias("ord", "piece")).where(F.trim("piece") != "")


def page_title(markdown: Column) -> Column:
    """The first three lines with text, fences left out, in 160 characters."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: (x != "") & ~x.startswith("```"))
    return F.substring(F.array_join(F.slice(lines, 1, 3), " "), 1, 160)


def verdict_of(description: Column) -> Column:
    """The verdict named on a line of its own, if it is one of the three."""
    found = F.lower(F.regexp_extract(description, r"(?im)^verdict:[ \t]*(\w+)", 1))
    return F.when(found.isin(*VERDICTS), found)


def without_verdict(description: Column) -> Column:
    return F.array_join(F.filter(F.split(description, "\n"), lambda x: ~F.lower(x).startswith("verdict:")), "\n")


def cleaned(value: Column) -> Column:
    """Placeholders count as empty."""
    return F.when(F.lower(F.trim(value)).isin("n/a", "none", "null", "-", "empty", ""), F.lit("")).otherwise(F.trim(value))


def attribute_rows(figures: DataFrame, json: str = "attributes", most: int = 12) -> DataFrame:
    """Objects of a figure's JSON list, at most twelve, numbered; those without a name are left out."""
    kind = "array<struct<thing:string, colour:string, material:string, code:string>>"
    rows = figures.select("id", F.posexplode(F.slice(F.from_json(json, kind), 1, most)).alias("n", "o"))
    return rows.select("id", "n", *[cleaned(F.col(f"o.{c}")).alias(c) for c in ("thing", "colour", "material", "code")]).where("coalesce(thing, '') <> ''")


def split_codes(text: Column, least: int = 3) -> Column:
    """A text with three or more item codes cut before each of them; others stay whole."""
    n = F.regexp_count(text, F.lit(r"\b[A-Z]{2,}[0-9]+\b"))
    return F.when(n >= least, F.filter(F.split(text, r"(?=\b[A-Z]{2,}[0-9]+\b)"), lambda x: F.trim(x) != "")).otherwise(F.array(text))


def in_window(moment: Column, start: int, end: int) -> Column:
    """Minutes of the day between start and end, across midnight if end is before start."""
    at = F.hour(moment) * 60 + F.minute(moment)
    return (at >= start) & (at < end) if start <= end else (at >= start) | (at < end)


def deferred(size: Column, in_window: Column, gpu: bool = False, most_mb: int = 50) -> Column:
    """Large files wait for the window, unless they are read on a GPU; a limit of 0 lets none wait."""
    if gpu or most_mb <= 0:
        return F.lit(False)
    return ~in_window & (size > most_mb * 1024 * 1024)


def backfilled(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """Chunks with pieces added that aren't among them yet: the same source, document, page and content is there once."""
    place = ["source_id", "document", "page"]
    held = chunks.select(*[F.col(c).alias(f"_{c}") for c in place], F.sha2("content", 256).alias("_hash")).distinct()
    same = F.sha2("content", 256) == F.col("_hash")
    for c in place:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    new = pieces.select(*place, "content").dropDuplicates([*place, "content"]).join(held, same, "left_anti")
    return chunks.select(*place, "content").unionByName(new)


def caption(description: Column, page: Column, most: int = 60) -> Column:
    """The part before the long dash, cut with an ellipsis; the page where there is none."""
    head = F.trim(F.element_at(F.split(description, " — "), 1))
    cut = F.when(F.length(head) > most, F.concat(F.substring(head, 1, most - 1), F.lit("…"))).otherwise(head)
    return F.when(F.coalesce(head, F.lit("")) == "", F.concat(F.lit("page "), page.cast("string"))).otherwise(cut)


def sampled_pages(pages: Column) -> Column:
    """Evenly spaced page numbers: a twentieth of all, at least 5 and at most 12."""
    n = F.least(pages, F.greatest(F.lit(5), F.least(F.lit(12), F.floor(pages * 0.05).cast("int"))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * pages / n).cast("int"))).otherwise(F.array().cast("array<int>"))


def stable_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of paths after a new reading: known paths keep theirs, others follow the largest; vanished ones go.

    New ids are numbered within 256 hash ranges, so no task numbers all of them.
    """
    known = new.join(old, ["source_id", "path"], "left")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    nth = F.row_number().over(Window.partitionBy("range").orderBy("source_id", "path")) - 1
    added = known.where("id is null").withColumn("range", F.pmod(F.xxhash64("source_id", "path"), F.lit(256))).withColumn("id", F.lit(top) + 1 + nth * 256 + F.col("range")).drop("range")
    return known.where("id is not null").unionByName(added)


def manifest_backlog(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """For each document: chunks without a vector, figures without vector or description."""
    c = chunks.groupBy("document").agg(F.count_if(F.col("embedding").isNull()).alias("chunks_without_vector"))
    f = figures.groupBy("document").agg(F.count_if(F.col("embedding").isNull()).alias("figures_without_vector"), F.count_if(F.coalesce("description", F.lit("")) == "").alias("figures_without_text"))
    return c.join(f, "document", "full").na.fill(0)


def worklist(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of which ``done`` has no row with the same key, null as a value: what a next round has to do."""
    right = done.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(right, same, "left_anti")


def figure_pieces(figures: DataFrame, titles: DataFrame) -> DataFrame:
    """Descriptions of figures as pieces behind their page's title; decoration and empty ones are left out."""
    t = titles.select(F.col("document").alias("_d"), F.col("page").alias("_p"), "title")
    rows = figures.join(t, (F.col("document") == F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")), "left")
    shown = squeezed(without_verdict(F.col("description")))
    rows = rows.where((F.coalesce(shown, F.lit("")) != "") & ~F.coalesce(verdict_of(F.col("description")) == "decoration", F.lit(False)))
    title = F.when(F.col("title") != "", F.col("title"))
    return rows.select("id", "document", "page", F.concat_ws(" | ", title, F.concat(F.lit("Image: "), shown)).alias("piece"))


def heading_sample(pieces: DataFrame, most: int = 120, width: int = 120, looked_at: int = 360) -> DataFrame:
    """First line of each of a document's first pieces (document, ord, piece), tables left out, each once, in order."""
    first = F.get(F.filter(F.transform(F.split("piece", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("|")), 0)
    rows = pieces.withColumn("_nth", F.row_number().over(Window.partitionBy("document").orderBy("ord"))).where(F.col("_nth") <= looked_at)
    lines = rows.select("document", "ord", F.substring(first, 1, width).alias("line")).where("line is not null").groupBy("document", "line").agg(F.min("ord").alias("ord"))
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("document").orderBy("ord"))).where(F.col("nth") <= most).select("document", "nth", "line")


def page_texts(pieces: DataFrame, most: int = 2500) -> DataFrame:
    """Text of each page (document, page, ord, piece), its pieces in order, of at most ``most`` characters.

    Only pieces that begin within ``most`` characters are gathered.
    """
    own = Window.partitionBy("document", "page").orderBy("ord")
    before = F.coalesce(F.sum(F.length("piece") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("_before", before).where(F.col("_before") < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"])
    return rows.groupBy("document", "page").agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("text"))


def stride_sample(rows: DataFrame, key: str, order: str, most: int = 12) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in order."""
    own = Window.partitionBy(key)
    marked = rows.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_i", F.row_number().over(own.orderBy(order)) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return marked.where((F.col("_i") % step == 0) & (F.col("_i") / step < most)).drop("_n", "_i")


def is_mark(description: Column) -> Column:
    """Marks and labels rather than pictures, or a description broken off."""
    return description.rlike("(?i)" + "|".join(MARKS))


def one_dimension(index: DataFrame, column: str = "embedding") -> int:
    """The dimension of all vectors of an index; ValueError, so that nothing is written, where there are several."""
    sizes = [r["n"] for r in index.select(F.size(column).alias("n")).where("n >= 0").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of several dimensions: {sorted(sizes)}")
    return sizes[0] if sizes else 0

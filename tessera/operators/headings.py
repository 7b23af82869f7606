"""Blocks of a document under the path of their headings, by windows over its lines.

A layout reader gives Markdown, a page at a time; HTML pages are brought to it by
rules for their block tags. Each block (lines up to a blank one or a heading) gets
the last heading of each level above it; a heading ends the deeper levels before it.
Built-in functions only: one sort by document, whatever the number of levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: What is between path parts.
ARROW = " > "


def html_to_markdown(html: Column) -> Column:
    """Headings, list items and paragraphs of a page as Markdown blocks; scripts, styles, comments and the head are left out."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("head", "script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[ >].*?</{tag}>", "")
    out = F.regexp_replace(out, r"\s+", " ")
    for level in range(1, LEVELS + 1):
        out = F.regexp_replace(out, rf"(?i)<h{level}[^>]*>", "\n\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "\n\n- ")
    out = F.regexp_replace(out, r"(?i)</?(h[1-6]|p|li|ul|ol|div|section|article|nav|header|footer|main|aside|table|tr|td|th|pre|blockquote|br|hr|body|html)(>|[ /][^>]*>)", "\n\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def heading_blocks(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """document, block, page, path, text and piece of each block of ``pages`` (document, page, Markdown).

    Headings hold over page ends, blocks don't. Lines
    in code fences are no headings, and blank ones there end no block. A null text
    has no blocks; a heading without anything below it is a path only.
    """
    lines = pages.select("document", "page", F.posexplode(F.split(F.col(f"`{text}`"), "\r?\n")).alias("pos", "line"))
    order = [F.coalesce("page", F.lit(-1)), F.col("pos")]
    upto = Window.partitionBy("document").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("document").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    inside = (F.coalesce(F.sum("fence").over(before), F.lit(0)) % 2 == 1) | (F.col("fence") == 1)
    level = F.when(~F.col("inside"), F.nullif(F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})\s+\S", 1)), F.lit(0)))
    title = F.regexp_replace(F.regexp_replace("line", r"^\s*#+\s+", ""), r"(\s+#+)?\s*$", "")
    rows = lines.withColumn("fence", fence).withColumn("inside", inside).withColumn("level", level).withColumn("at", F.row_number().over(Window.partitionBy("document").orderBy(*order)))
    blank = ~F.col("inside") & (F.trim(F.regexp_replace("line", r"\s+", " ")) == "")
    rows = rows.withColumn("blank", blank).withColumn("block", F.sum((blank | F.col("level").isNotNull() | (F.col("pos") == 0)).cast("int")).over(upto))
    last = [F.last(F.when(F.col("level") == k, F.struct(F.col("at").alias("at"), title.alias("title"))), ignorenulls=True).over(upto) for k in range(1, LEVELS + 1)]
    rows = rows.withColumn("last", F.array(*last)).where(F.col("level").isNull() & ~F.col("blank"))
    # a heading counts if none of a higher rank came after it
    held = F.filter("last", lambda h, i: h.isNotNull() & F.forall(F.slice("last", 1, i), lambda above: above.isNull() | (above["at"] < h["at"])))
    path = F.array_join(F.transform(held, lambda h: h["title"]), ARROW)
    whole = rows.withColumn("path", path).groupBy("document", "block").agg(
        F.min_by("page", "at").alias("page"), F.min("path").alias("path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return whole.withColumn("piece", F.concat_ws("\n", F.nullif("path", F.lit("")), F.col("text")))

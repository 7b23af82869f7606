"""Structure-aware pieces of documents: folds over a document's fragments, one group a document.

A document's fragments are one document's text; groups are as large as the
longest document and are dealt by document.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, TITLE, CONTEXT, VARIANT_CHARS, VARIANT_WORDS = 300, 1800, 200, 15, 80, 6
# Fixed value: how the code of a variant row begins.
_CODE = re.compile(r"^[A-Z]{2,5}[-\s]?\d{3,}\b")
PIECES = "document string, ord int, page int, piece string"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.string())
#: Texts whose pieces a task holds at once.
AT_ONCE = 64


def is_variant(text: str) -> bool:
    """A short row that begins with an item code."""
    return len(text) <= VARIANT_CHARS and len(text.split()) <= VARIANT_WORDS and bool(_CODE.match(text))


def cut_long(text: str) -> list[str]:
    """Pieces of at most ``MOST`` characters, cut at a late line end if there is one."""
    out = []
    while len(text) > MOST:
        at = text.rfind("\n", LEAST, MOST)
        at = at if at > 0 else MOST
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def merged(fragments: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    """Fragments of a page joined while short; variant rows stay apart, each behind the page's title.

    White space inside a fragment is squeezed. The title is the page's first
    fragment of ``CONTEXT`` characters or more that is no variant row.
    """
    out: list[tuple[str, int | None]] = []
    for page, run in groupby(fragments, key=lambda f: f[1]):
        texts = [t for t in (" ".join((f[0] or "").split()) for f in run) if t]
        title = next((t[:TITLE] for t in texts if len(t) >= CONTEXT and not is_variant(t)), "")
        prose: list[str] = []
        for text in [*texts, None]:
            whole = "\n".join(prose)
            if prose and (text is None or is_variant(text) or len(whole) >= LEAST or len(whole) + len(text) > MOST):
                out += [(t, page) for t in cut_long(whole)]
                prose = []
            if text is not None and is_variant(text):
                out.append((f"{title} | {text}" if title else text, page))
            elif text is not None:
                prose.append(text)
    return out


def table_pieces(rows: list[str], title: str) -> list[str]:
    """A small table whole; a large one row by row, each behind title and header."""
    whole = "\n".join(rows)
    if len(whole) <= MOST:
        return [f"{title}\n{whole}" if title else whole]
    before = [x for x in (title, rows[0]) if x]
    return [" | ".join([*before, r]) for r in rows[1:] if not re.fullmatch(r"[\s|:-]+", r)]


def markdown_pieces(markdown: str) -> list[str]:
    """Pieces of a page: bullets one by one and prose by block under the last heading; tables by ``table_pieces``.

    Lines right after a heading belong to it while it has at most ``TITLE``
    characters; a longer line is prose. A heading with nothing under it is a
    piece of its own. All text but fences and rules is in some piece.
    """
    out: list[str] = []
    title, block, table, heading_open, used = "", [], [], False, True

    def flush():
        nonlocal used
        if block:
            text = "\n".join(block)
            out.extend(cut_long(f"{title}\n{text}" if title else text))
        if table:
            out.extend(table_pieces(table, title))
        used = used or bool(block or table)
        block.clear()
        table.clear()

    def close():
        flush()
        if title and not used:
            out.extend(cut_long(title))

    for line in (markdown or "").split("\n"):
        s = line.strip()
        if s.startswith("```") or re.fullmatch(r"-{3,}|\*{3,}|_{3,}", s):
            continue
        if not s:
            flush()
            heading_open = False
        elif s.startswith("#"):
            close()
            title, heading_open = s.lstrip("# ").strip(), True
            used = not title
        elif s.startswith("|"):
            if block:
                flush()
            table.append(s)
            heading_open = False
        elif m := re.match(r"[-*•]\s+(.*)", s):
            flush()
            out.extend(cut_long(f"{title} | {m[1]}" if title else m[1]))
            heading_open, used = False, True
        elif heading_open and len(title) + 1 + len(s) <= TITLE:
            title = f"{title} {s}".strip()
            used = False
        else:
            if table:
                flush()
            block.append(s)
            heading_open = False
    close()
    return out


def _cut(rows: DataFrame, text: str, pieces) -> DataFrame:
    """``PIECES`` of rows (document, page, ``text``): ``pieces`` gives a text's pieces; few texts and their pieces are held at once."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                out = [(d, i, p, t) for d, p, whole in zip(*(c.to_pylist() for c in batch.slice(begin, AT_ONCE).columns), strict=True) for i, t in enumerate(pieces(whole, p))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], ["document", "ord", "page", "piece"])

    return rows.select("document", F.col("page").cast("int"), text).mapInArrow(run, PIECES)


def merge_texts(rows: DataFrame) -> DataFrame:
    """``merged`` over the paragraphs of whole texts (document, page, content), one row a page: no shuffle, as a text is where it is."""
    return _cut(rows, "content", lambda content, page: [t for t, _ in merged([(x, page) for x in (content or "").split("\n")])])


def merge_fragments(rows: DataFrame) -> DataFrame:
    """``merged`` over each document of stored fragments (document, ord, page, piece)."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        pages = [None if pd.isna(p) else int(p) for p in group["page"]]
        pieces = merged(list(zip(group["piece"], pages, strict=True)))
        return pd.DataFrame({"document": group["document"].iloc[0], "ord": range(len(pieces)), "page": pd.array([p for _, p in pieces], "Int32"), "piece": [t for t, _ in pieces]})

    return rows.groupBy("document").applyInPandas(fold, PIECES)


def split_pages(rows: DataFrame) -> DataFrame:
    """``markdown_pieces`` of each page (document, page, markdown)."""
    return _cut(rows, "markdown", lambda markdown, _: markdown_pieces(markdown))

"""Words, rarity, patterns and numbers in texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
# Latin letters with accents, and without.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def analyse(text: str) -> list[str]:
    """``words`` of a query text, each once, on the driver."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def plain(text: Column) -> Column:
    """Lower case, no accents, one space between words."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+", " "))


def squeezed(text: Column) -> Column:
    """White space squeezed to single spaces."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def document_frequency(rows: DataFrame, text: str = "content") -> DataFrame:
    """word and n_chunks: in how many rows each word occurs."""
    return rows.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_chunks"))


def term_weights(frequencies: DataFrame, terms: list[str], total: int, divisor: int, fallback: bool = False) -> tuple[list[tuple[str, float]], list[str]]:
    """(word, ln(total / frequency)) of the query's words, and those rare enough to select rows.

    A word is rare if it is in at most total // divisor rows; an unknown word
    counts as in one. With ``fallback`` all words select where none is rare.
    """
    import math

    known = {r["word"]: r["n_chunks"] for r in frequencies.where(F.col("word").isin(terms)).collect()} if terms else {}
    weights = [(t, math.log(total / known.get(t, 1))) for t in terms] if total else []
    rare = [t for t in terms if known.get(t, 1) <= total // divisor]
    return weights, rare or (list(terms) if fallback else [])


def term_score(text: Column, weights: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the words that occur."""
    own = words(text)
    out = F.lit(0.0)
    for term, weight in weights:
        out = out + F.when(F.array_contains(own, term), F.lit(weight)).otherwise(F.lit(0.0))
    return out


def whole_word(term: str) -> str:
    """Pattern for a word, whatever its case, with trailing punctuation of the term left off."""
    return rf"(?i)\b{re.escape(term.rstrip('.,;:!?'))}\b"


def any_word(terms: list[str]) -> str:
    """Alternation of single words; terms of several words are left out."""
    single = [re.escape(t) for t in terms if t and " " not in t]
    return "|".join(single) if single else r"(?!)"


def contains(text: Column, term: str) -> Column:
    """Literal containment, whatever the case; no wildcard has a meaning."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def price_below(text: Column, limit: float) -> Column:
    """A number with two decimals below ``limit`` occurs in the text."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}[.,]\d{2})\b"), F.lit(1))
    return F.exists(found, lambda x: F.translate(x, ",", ".").cast("double") < F.lit(limit))


def codes(text: Column) -> Column:
    """Item codes: two or more capitals followed by digits; each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,}[0-9]+)\b"), F.lit(1)))


def prose_share(text: Column) -> Column:
    """Share of words that are alphabetic and longer than three letters."""
    all_words = F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != "")
    return F.when(F.size(all_words) > 0, F.size(F.filter(all_words, lambda w: w.rlike(r"^\p{L}{4,}$"))) / F.size(all_words)).otherwise(F.lit(0.0))


def expanded_query(original: str, terms: list[str], values: list[str]) -> str:
    """The query and what it lacks of terms and constraint values, in order, each once."""
    low = original.lower()
    return " ".join([original, *[t for t in dict.fromkeys([*terms, *values]) if t.lower() not in low]])

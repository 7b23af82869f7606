"""Bounds on what an untrusted author may run: seconds, rows, patterns; and errors an author can act on."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds and rows of one run. Fixed values.
SECONDS, ROWS = 15.0, 40

#: Beginnings of Spark's error conditions, by what an author has to mend.
FAMILIES = {
    "unknown name": ("UNRESOLVED_COLUMN", "UNRESOLVED_FIELD", "TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_ROUTINE", "UNRESOLVED_MAP_KEY", "CANNOT_RESOLVE", "AMBIGUOUS_REFERENCE", "FIELD_NOT_FOUND"),
    "syntax": ("PARSE_", "UNTERMINATED", "INVALID_SQL_SYNTAX", "UNSUPPORTED_FEATURE"),
    "grouping": ("MISSING_AGGREGATION", "MISSING_GROUP_BY", "GROUP_BY", "GROUPING", "NESTED_AGGREGATE", "INVALID_WHERE_CONDITION", "UNSUPPORTED_EXPR_FOR_OPERATOR"),
    "types": ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "INVALID_PARAMETER_VALUE", "WRONG_NUM_ARGS", "DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW"),
}


class NotRun(Exception):
    """Why an author's run has no rows: its ``family`` and what to do."""

    def __init__(self, family: str, message: str):
        super().__init__(f"{family}: {message}")
        self.family, self.message = family, message


def family_of(error: Exception) -> str:
    """What an error is about, by the condition that Spark gives it."""
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    for family, beginnings in FAMILIES.items():
        if condition.startswith(beginnings):
            return family
    return "not allowed" if isinstance(error, ValueError) else "not run"


def bounded(spark: SparkSession, make: Callable[[], DataFrame], seconds: float = SECONDS, rows: int = ROWS) -> tuple[list, bool]:
    """The first rows of what ``make`` gives, and whether there are more.

    All jobs of the run carry a tag of their own; when its seconds are over, jobs
    with the tag are ended until the run is, and others go on. Raises ``NotRun``.
    """
    context, tag, done = spark.sparkContext, f"bounded-{uuid.uuid4().hex}", threading.Event()
    late = threading.Event()

    def end():
        if not done.wait(seconds):
            late.set()
            while not done.is_set():  # a run may start further jobs
                context.cancelJobsWithTag(tag)
                done.wait(0.1)

    watch = threading.Thread(target=end, daemon=True)
    context.addJobTag(tag)
    watch.start()
    try:
        found = make().limit(rows + 1).collect()
    except Exception as e:
        if late.is_set():
            raise NotRun("too slow", f"ended after {seconds:g} seconds; ask for less") from None
        raise NotRun(family_of(e), str(e).strip().splitlines()[0][:200]) from e
    finally:
        done.set()
        context.removeJobTag(tag)
        watch.join()
    if late.is_set():
        raise NotRun("too slow", f"ended after {seconds:g} seconds; ask for less")
    return found[:rows], len(found) > rows


def alternatives(pattern: Column) -> Column:
    """Parts of a pattern between bars."""
    return F.split(pattern, r"\|")


def refused_alternatives(pattern: Column) -> Column:
    """Alternatives that hold white space: they ask for words side by side, which hardly ever are."""
    return F.transform(F.filter(alternatives(pattern), lambda a: F.trim(F.regexp_replace(a, r"\s", " ")).contains(" ")), lambda a: F.trim(a))


def cleaned_pattern(pattern: Column) -> Column:
    """The pattern without them; null where none is left."""
    good = F.filter(alternatives(pattern), lambda a: (F.trim(F.regexp_replace(a, r"\s", " ")) != "") & ~F.trim(F.regexp_replace(a, r"\s", " ")).contains(" "))
    return F.when(F.size(good) > 0, F.array_join(good, "|"))


def checked_pattern(pattern: str) -> str:
    """The pattern, or ValueError that names the first bad alternative and what to ask instead."""
    parts = pattern.split("|")
    bad = [a.strip() for a in parts if len(a.split()) > 1]
    if not bad:
        return pattern
    good = [a for a in parts if len(a.split()) == 1]
    first, last = bad[0].split()[0], bad[0].split()[-1]
    hint = f"leave it out: '{'|'.join(good)}'" if good else f"ask for '{first}' and '{last}' in two conditions"
    raise ValueError(f"the pattern '{pattern}' has an alternative with a space: '{bad[0]}'; {hint}")

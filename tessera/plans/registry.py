"""All queries of the engine, and the SQL that checks them."""

from __future__ import annotations

from . import corpus, indexes, records, search, texts, versions  # noqa: F401  (these register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

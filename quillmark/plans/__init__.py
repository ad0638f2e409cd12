"""Whole queries over a folder of tables, with SQL for the same result."""

from . import arabic, extraction, matching, verdicts
from .common import Query

QUERIES: dict[str, Query] = {**matching.QUERIES, **extraction.QUERIES, **verdicts.QUERIES, **arabic.QUERIES}

"""All queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from wardloom.plans import log_queries, roll_queries, text_queries
from wardloom.plans.book import Query

BOOKS = (text_queries.book, roll_queries.book, log_queries.book)


def queries() -> dict[str, Query]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}

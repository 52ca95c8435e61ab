"""All queries of the library outside the subpackage ``llm``."""

from __future__ import annotations

from pagemill.plans import book_queries, data_queries, reply_queries, text_queries
from pagemill.runtime import Query, merged


def queries() -> dict[str, Query]:
    return merged([data_queries.QUERIES, text_queries.QUERIES, book_queries.QUERIES, reply_queries.QUERIES])


def oracles() -> dict[str, str]:
    return merged([data_queries.ORACLES, text_queries.ORACLES, book_queries.ORACLES, reply_queries.ORACLES])

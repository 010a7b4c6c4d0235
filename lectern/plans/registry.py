"""All registered queries and their SQL twins."""

from __future__ import annotations

from functools import wraps

from lectern.plans import (
    article_queries,
    chat_queries,
    search_queries,
    state_queries,
    store_queries,
    stream_queries,
    text_queries,
)
from lectern.session import ship_package

MODULES = [text_queries, store_queries, search_queries, article_queries, state_queries, chat_queries, stream_queries]

#: Rows that a Python worker holds of its input at once: whole texts, and what is derived from them.
BATCH_ROWS = "2048"


def in_utc(query):
    """Times of the tables carry no zone; the queries and their SQL read them as UTC."""

    @wraps(query)
    def run(spark, root):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        ship_package(spark)
        return query(spark, root)

    return run


def queries() -> dict:
    return {name: in_utc(query) for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

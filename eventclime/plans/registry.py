"""All registered queries and their oracle SQL, in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import batch_queries, file_queries, stream_queries


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(batch_queries.QUERIES)
    out.update(file_queries.QUERIES)
    out.update(stream_queries.QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    out = dict(batch_queries.ORACLE_SQL)
    out.update(file_queries.ORACLE_SQL)
    out.update(stream_queries.oracle())
    return out

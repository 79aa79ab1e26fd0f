"""Names of the core's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name and, if there is one, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def image_name_sql(c: str) -> str:
    """strings.image_name in SQL."""
    return f"""lower(trim(replace(url_decode(case when starts_with({c}, 'File:') then substr({c}, 6)
when contains({c}, 'Special:FilePath/') then regexp_replace({c}, '^.*?Special:FilePath/', '')
when contains({c}, '/wikipedia/commons/') then regexp_extract(regexp_replace({c}, '/+$', ''), '[^/]*$') else {c} end), '_', ' ')))"""

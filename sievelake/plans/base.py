"""What the modules of queries share: the registry's tables, readers, and pieces of DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelake.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]
#: Queries and statements by name; modules of this folder fill them when they are imported.
QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            STATEMENTS[f.__name__] = sql
        return f

    return put


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_tokens(c: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{tx.TOKEN}'), lambda t: NOT list_contains({sql_list(stop)}, t)))"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{tx.SPACE}', ' ', 'g'))"


def sql_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def sql_preview(c: str, limit: int) -> str:
    return f"CASE WHEN length({sql_collapse(c)}) <= {limit} THEN {sql_collapse(c)} ELSE rtrim(substr({sql_collapse(c)}, 1, {limit - 3}), ' ') || '...' END"

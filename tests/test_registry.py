"""Every query of the registry against its DuckDB statement on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from sievelake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(DATA)]


def plain(v):
    """Numbers at 9 significant digits, which the statements' rounding to 6 decimals needs."""
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (float, Decimal, int)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    r = duck.execute(registry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    cols = sorted(df.columns)
    assert cols == sorted(at)
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(plain(x[at[c]]) for c in cols) for x in r.fetchall())


def test_every_query_has_a_statement_or_a_test():
    # Markdown and facts of pages, and state machines, are held against literal cases and plain loops elsewhere.
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"page_markdown", "html_tables", "rate_limits", "circuit_breakers"}

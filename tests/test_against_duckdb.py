"""The registered queries with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans import account_queries, collection_queries, document_queries, file_queries, further_queries, log_queries, privacy_queries, registry, registry_all, session_queries, streaming_queries, text_queries, timer_queries, wire_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
MODULES = (account_queries, collection_queries, document_queries, file_queries, further_queries, log_queries, privacy_queries, session_queries, streaming_queries, text_queries, timer_queries, wire_queries)
NAMES = [n for n, q in registry.queries().items() if n in registry.oracle_sql() and q.__module__ in {m.__name__ for m in MODULES}]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=repr)
    b = sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)
    assert a == b

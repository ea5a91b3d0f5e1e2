"""Compares a query with its SQL in DuckDB, rows in any order."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def rows(names, values):
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr([plain(r[i]) for i in at]) for r in values)


def check(spark, f, sql: str, sf: str = SF):
    got = f(spark, sf)
    want = connect(sf).sql(sql)
    names, values = list(want.columns), want.fetchall()
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, values)
    assert len(a) == len(b)
    assert a == b

"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(cols)


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = os.path.join(sf, f)
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = query(spark, sf)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    want = _rows(rel.fetchall(), [c[0] for c in rel.description])
    assert got[1] == want[1]
    assert got[0] == want[0]

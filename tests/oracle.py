"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from pathlib import Path

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in data)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(sql)
    names, expected = [d[0] for d in want.description], want.fetchall()
    df = query(spark, str(sf_dir))
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, expected)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:3]

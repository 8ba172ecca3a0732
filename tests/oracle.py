"""Compare a query's rows with its SQL as DuckDB runs it, whatever their order."""

from __future__ import annotations

import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            at = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    r = tables(sf_dir).execute(sql)
    names = [d[0] for d in r.description]
    want = rows(names, r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[0])

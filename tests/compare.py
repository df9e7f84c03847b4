"""Run a registered query and its SQL and compare them value by value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when both results are equal."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    problems = []
    if not want_rows:
        return ["the SQL has no rows, so nothing is compared"]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if len(got_rows) != len(want_rows):
        problems.append(f"rows {len(got_rows)} != {len(want_rows)}")
    got, want = _rows(spark_df.columns, got_rows), _rows(names, want_rows)
    bad = [(g, w) for g, w in zip(got, want) if g != w or repr(g) != repr(w)]
    if bad:
        problems.append(f"{len(bad)} differing rows, first: {bad[0][0]} != {bad[0][1]}")
    return problems

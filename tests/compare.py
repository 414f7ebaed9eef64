"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else ("-0.0" if math.copysign(1, v) < 0 else "0.0")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def difference(spark, con, fn, sql: str, sf: str) -> str | None:
    """None when rows, columns, types and values agree; otherwise what differs."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    left = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(n) for n in names]
    right = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    for i, n in enumerate(names):
        lt = {type(r[i]) for r in left if r[i] is not None}
        rt = {type(r[i]) for r in right if r[i] is not None}
        if lt != rt and lt and rt:
            return f"type of {n}: {lt} against {rt} ({[str(d[1]) for d in cur.description] if cur.description else ''})"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    a, b = sorted(left, key=repr), sorted(right, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ ({names}): " + "\n   ".join(
            f"{x}\n   {y}" for x, y in bad[:2]
        )
    return None

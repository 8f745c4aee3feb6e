"""Order-insensitive comparison of a Spark query with its SQL twin run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 5) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= 2e-5 * max(1.0, abs(a), abs(b))
    return a == b


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def sql_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall(), [str(d[1]) for d in rel.description]


KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "str", "date": "date"}


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    d_cols, d_rows, d_types = sql_rows(con, sql)
    if sorted(s_cols) != sorted(d_cols):
        return f"columns {sorted(s_cols)} vs {sorted(d_cols)}"
    for c, i in zip(s_cols, range(len(s_cols))):
        if any(isinstance(r[i], float) and math.isnan(r[i]) for r in s_rows):
            return f"NaN in {c}"
    types = dict(df.dtypes)
    dtypes = dict(zip(d_cols, d_types))
    for c in s_cols:
        got, want = types[c], dtypes[c].upper()
        ok = {
            "bigint": want == "BIGINT", "int": want == "INTEGER", "double": want == "DOUBLE", "string": want == "VARCHAR",
            "date": want == "DATE", "boolean": want == "BOOLEAN",
        }.get(got, False)
        if not ok:
            return f"type of {c}: {got} vs {want}"
    order = sorted(s_cols)
    key = lambda r: tuple((x is None, str(type(x).__name__ == "str"), x if x is not None else 0) for x in r)
    a = sorted((tuple(_norm(r[s_cols.index(c)]) for c in order) for r in s_rows), key=key)
    b = sorted((tuple(_norm(r[d_cols.index(c)]) for c in order) for r in d_rows), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first spark {a[:2]} sql {b[:2]}"
    for x, y in zip(a, b):
        if not all(_close(p, q) for p, q in zip(x, y)):
            return f"{order}\n   spark {x}\n   sql   {y}"
    if not a:
        return "EMPTY"
    return None

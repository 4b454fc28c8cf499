"""Runs a query and its SQL over the same tables and compares rows, column names and types."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, round(x, 5) if isinstance(x, float) else x) for x in row)


def differences(df, sql: str, con) -> list[str]:
    own, other = sorted(df.columns), con.sql(sql)
    if own != sorted(other.columns):
        return [f"columns {own} and {sorted(other.columns)}"]
    kinds = {c: KINDS.get(k, k) for c, k in df.dtypes}
    wrong = [f"{c}: {kinds[c]} and {k}" for c, k in zip(other.columns, map(str, other.types), strict=True) if kinds[c] != k]
    if wrong:
        return wrong
    a = sorted((tuple(r[c] for c in own) for r in df.collect()), key=_key)
    b = sorted(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in own)} FROM ({sql})").fetchall(), key=_key)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    same = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) or math.isnan(x) and math.isnan(y)))
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if not all(map(same, x, y))][:3]

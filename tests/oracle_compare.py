"""Side-by-side check of a Spark result against a DuckDB SQL result.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (floats compared after rounding)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from quarry.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows_of(pdf: pd.DataFrame, digits: int) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v, digits) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_diff(spark_df, con, sql: str) -> dict:
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    d_types = {r[0]: r[1] for r in con.sql(f"DESCRIBE {sql}").fetchall()}
    return {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
            if s_types.get(c) != d_types.get(c)}


def compare(spark_df, con, sql: str, digits: int = 6) -> tuple[bool, str]:
    td = type_diff(spark_df, con, sql)
    if td:
        return False, f"types differ (spark, duckdb): {td}"
    left = spark_df.toPandas()
    right = con.sql(sql).df()
    lc, rc = sorted(left.columns), sorted(right.columns)
    if lc != rc:
        return False, f"columns differ: spark={lc} duckdb={rc}"
    if len(left) != len(right):
        return False, f"row count differs: spark={len(left)} duckdb={len(right)}"
    lr, rr = rows_of(left, digits), rows_of(right, digits)
    for a, b in zip(lr, rr):
        if a != b:
            return False, f"first differing row:\n spark ={a}\n duckdb={b}"
    return True, f"{len(left)} rows match"

"""Local copy of the correctness gate: run a Spark query and its DuckDB SQL, compare.

Columns are sorted by name, rows are compared as an order-free multiset of
normalised tuples, exactly what the driver's value hash needs to agree on.
"""

from __future__ import annotations

import datetime as _dt
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = rel.fetchall()
    return [cols[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


# Spark simple type -> DuckDB type name (both engines must agree on the column types).
TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN",
            "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_problems(df, con, sql):
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    dt_ = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = []
    for c, t in st.items():
        want = TYPE_MAP.get(t)
        if want is not None and c in dt_ and dt_[c] != want:
            bad.append(f"{c}: spark {t} vs duck {dt_[c]}")
    return bad


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    problems = type_problems(df, con, sql)
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    if len(sr) != len(dr):
        problems.append(f"row count spark={len(sr)} duck={len(dr)}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ss, ds = sorted(sr, key=key), sorted(dr, key=key)
    if not problems and ss != ds:
        diff = [(a, b) for a, b in zip(ss, ds) if a != b][:3]
        problems.append(f"values differ, first: {diff}")
    return len(sr), problems

"""Order-insensitive comparison of a Spark result with DuckDB's."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(norm, r)) for r in df.select(*(df[c] for c in cols)).collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    return cols, sorted(tuple(map(norm, r)) for r in con.sql(f"select {names} from ({sql})").fetchall())

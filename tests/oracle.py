"""Rows of a query and of its SQL, made comparable."""

import math
import os
from decimal import Decimal

import duckdb


def plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    return int(value) if isinstance(value, bool) else value


def connection(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def of_spark(df):
    columns = sorted(df.columns)
    return columns, ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])


def of_sql(con, sql: str):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(names)
    index = [names.index(c) for c in columns]
    return columns, ordered([tuple(plain(r[i]) for i in index) for r in found.fetchall()])

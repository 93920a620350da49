"""Rows of Spark and of DuckDB in one comparable form."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def of_spark(df):
    names = sorted(df.columns)
    return names, ordered(tuple(plain(r[n]) for n in names) for r in df.collect())


def of_duckdb(c, sql):
    cur = c.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, ordered(tuple(plain(r[k]) for k in at) for r in cur.fetchall())

"""Compares a query with its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*names).collect())


def sql_rows(con, sql):
    names = sorted(con.sql(sql).columns)
    listed = ", ".join(f'"{n}"' for n in names)
    return names, sorted(repr(tuple(plain(x) for x in r)) for r in con.sql(f"select {listed} from ({sql})").fetchall())

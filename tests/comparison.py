"""Rows of Spark and DuckDB in one form."""

import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if x != x else round(x, 9) + 0.0
    if isinstance(x, list | tuple):
        return tuple(plain(i) for i in x)
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def in_order(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, in_order(df.select(*names).collect())


def duck_rows(sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], in_order([r[i] for i in order] for r in got.fetchall())

"""Spark's rows against DuckDB's, as sorted lists of plain values."""

import glob
import math
import os

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def both(spark, sf_dir, query, sql):
    made = query(spark, sf_dir)
    cursor = duck(sf_dir).execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(made.columns) == sorted(names)
    return rows_of(made.columns, made.collect()), rows_of(names, cursor.fetchall())

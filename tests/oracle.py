"""Runs a query against its SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import glob
import math

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = p.rsplit("/", 1)[1].removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return db


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, db, sf_dir, f, sql):
    """(row counts, column names equal, rows equal, first differences)"""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    types = [(c, t, str(rel.types[rel.columns.index(c)])) for c, t in df.dtypes if c in rel.columns]
    return len(got), len(want), sorted(df.columns) == sorted(rel.columns), got == want, diff, types

"""Compares a query's rows with those of its SQL in another engine."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _value(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def compare(spark, query, sql, sf_dir):
    df, rel = query(spark, sf_dir), views(sf_dir).sql(sql)
    names, theirs = sorted(df.columns), list(rel.columns)
    assert names == sorted(theirs)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=key)
    other = sorted((tuple(_value(r[theirs.index(n)]) for n in names) for r in rel.fetchall()), key=key)
    assert len(mine) == len(other)
    wrong = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    assert not wrong, wrong[:3]

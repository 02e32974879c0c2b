"""Runs an oracle query on the Parquet tables of a folder, and compares whole results."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir, sql, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9) + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(frame, sf_dir, sql, tables=None):
    columns, rows = oracle(sf_dir, sql, tables)
    assert sorted(frame.columns) == sorted(columns)
    got, want = canonical(frame.columns, [tuple(r) for r in frame.collect()]), canonical(columns, rows)
    assert len(got) == len(want)
    differ = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differ, differ[:3]

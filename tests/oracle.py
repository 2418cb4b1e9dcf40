"""Side-by-side comparison of a query with its SQL in DuckDB, order-insensitive, columns by name."""

import os
from collections import Counter
from pathlib import Path

import duckdb


def connect(d):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def same(spark, query, sql, d):
    df = query(spark, d)
    cur = connect(d).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    return bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, cur.fetchall())

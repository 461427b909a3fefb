"""Compares a query with its SQL as DuckDB runs it."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return (type(v).__name__, v)
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(map(plain, v)))
    return ("n", "nan" if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}"))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    a = [x for x in got[1] if x not in set(want[1])][:2]
    b = [x for x in want[1] if x not in set(got[1])][:2]
    return f"{len(got[1])} rows and {len(want[1])}; Spark only: {a}; SQL only: {b}"[:900]

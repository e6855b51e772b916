"""Compare a query with its SQL the way a value hash does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return repr(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = run(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    theirs = rows([d[0] for d in rel.description], rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows; " + str(sorted(set(mine[1]) ^ set(theirs[1]))[:4])
    odd = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else None

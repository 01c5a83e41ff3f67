"""Run a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    names, ours = spark_rows(query(spark, sf_dir))
    theirs_names, theirs = sql_rows(duck(sf_dir), sql)
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
    return ""

"""Holds a query's rows against its SQL counterpart in DuckDB, value by value, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if isinstance(value, bool | int | str | bytes) or value is None:
        return value
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else str(value)


def connection(data: Path = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data / name}.parquet')")
    return con


def difference(spark, query, sql: str, con, data: Path = DATA) -> str:
    """What differs, or the empty text."""
    frame = query(spark, str(data))
    names = sorted(frame.columns)
    mine = Counter(tuple(plain(row[c]) for c in names) for row in frame.collect())
    cursor = con.execute(sql)
    theirs_names = [c[0] for c in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(c) for c in names]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} rows against {sum(theirs.values())}; columns {names}; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"

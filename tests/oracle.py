"""Spark rows against DuckDB rows, column by column, whatever their order."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def bag(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(con, frame, sql):
    theirs = con.sql(sql)
    assert sorted(frame.columns) == sorted(theirs.columns)
    ours, other = bag(frame.columns, [tuple(r) for r in frame.collect()]), bag(theirs.columns, theirs.fetchall())
    assert ours - other == Counter() and other - ours == Counter()

"""Compare registered queries with their SQL on DuckDB: names, row counts and values."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "%.6f" % (value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(spark_df, con, sql: str) -> str | None:
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = sql_rows(con, sql)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; e.g. {got[1][:2]} vs {want[1][:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, e.g. {bad[:2]}"
    return None

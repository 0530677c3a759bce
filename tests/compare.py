"""Runs registered queries against their SQL twins on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, name, folder):
    """(ok, message) for one query."""
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    df = queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    text = oracle_sql().get(name)
    if text is None:
        return True, f"rows only: {len(rows)} rows, {took:.1f}s"
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    cols, got = normal(df.columns, rows)
    ocols, exp = normal(want_cols, want)
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    if got != exp:
        extra = [r for r in got if r not in set(exp)][:3]
        missing = [r for r in exp if r not in set(got)][:3]
        return False, f"{len(got)} vs {len(exp)} rows; only spark {extra}; only sql {missing}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return True, f"{len(got)} rows, {took:.1f}s, {[(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields]}"


if __name__ == "__main__":
    from __spark_entry__ import queries
    from paperfold.session import local_session

    folder = sys.argv[1]
    wanted = [n for n in queries() if not sys.argv[2:] or any(n.startswith(p) or p in n for p in sys.argv[2:])]
    session = local_session("8")
    con = connect(folder)
    bad = 0
    for name in wanted:
        try:
            ok, message = check(session, con, name, folder)
        except Exception as exc:  # report every query, then fail at the end
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, message, flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")

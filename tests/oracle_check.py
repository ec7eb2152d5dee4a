"""Compares registered queries with their SQL; ``python tests/oracle_check.py [name ...]``."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else float(value)
    return str(value)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(picked, key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    names, rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected_names = [d[0] for d in result.description]
    expected_names, expected = _sorted(expected_names, result.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    if not rows:
        return "no rows"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    return f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from packetloom.session import local_session

    spark = local_session("8", 8)
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    chosen = sys.argv[1:] or list(entry.queries())
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else (None if df.count() else "no rows")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {'' if name in entry.oracle_sql() else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)

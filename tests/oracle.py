"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in data),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, key):
    """An empty string when both sides agree, else what differs."""
    df = entry.queries()[key](spark, sf)
    got = _rows(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    same = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "double": "DOUBLE",
        "string": "VARCHAR",
        "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
    }
    for name, kind in df.dtypes:
        if same.get(kind, kind) != types[name]:
            return f"column {name} is {kind}, expected {types[name]}"
    return "" if want else "no rows"


if __name__ == "__main__":
    from millrace.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, con, sf, key)
        except Exception as error:  # reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{time.time() - start:6.2f}s {key}: {problem or 'ok'}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")

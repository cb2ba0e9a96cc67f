"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from starwake.checks import load
from starwake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "int": "INTEGER",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, name: str, one, folder: str) -> str | None:
    """None when both results are equal, else what differs."""
    df = one.run(spark, folder)
    rows = df.collect()
    if one.sql is None:
        return None if rows else "no rows"
    con.execute(one.sql)
    described = con.description
    theirs = [column[0] for column in described]
    expected = con.fetchall()
    if sorted(theirs) != sorted(df.columns):
        return f"columns {sorted(set(theirs) ^ set(df.columns))}"
    for column in described:
        mine = TYPES.get(df.schema[column[0]].dataType.simpleString(), "?")
        if mine != str(column[1]):
            return f"type of {column[0]}: {mine} against {column[1]}"
    names = sorted(df.columns)
    order = [theirs.index(column) for column in names]
    left = Counter(tuple(row[column] for column in names) for row in rows)
    right = Counter(tuple(row[at] for at in order) for row in expected)
    if left != right:
        only_left, only_right = list((left - right).items()), list((right - left).items())
        return (
            f"{len(rows)} against {len(expected)} rows; {names}\n   spark {sorted(only_left, key=str)[:2]}"
            f"\n   sql   {sorted(only_right, key=str)[:2]}"
        )
    return None if rows else "no rows"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    checks = load()
    chosen = sys.argv[2:] or list(checks)
    spark, con = local_session("8"), connect(folder)
    failed = 0
    for name in chosen:
        begun = time.time()
        try:
            problem = compare(spark, con, name, checks[name], folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed += 1
            print(f"FAIL {name} ({time.time() - begun:.1f}s): {problem}", flush=True)
        else:
            print(f"ok   {name} ({time.time() - begun:.1f}s)", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

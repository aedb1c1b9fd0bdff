"""Compare registered queries with their SQL: same columns, same rows, same values, any order.

Run as a script: ``python tests/oracle_check.py <folder> [name prefix ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def normal_rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both results are equal, otherwise what differs."""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = normal_rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    got = normal_rows(df.columns, df.collect())
    if got == want:
        return None
    extra, lacking = got - want, want - got
    return (
        f"{got.total()} rows instead of {want.total()}; {extra.total()} unexpected, {lacking.total()} lacking; "
        f"e.g. {sorted(extra, key=str)[:2]} instead of {sorted(lacking, key=str)[:2]}"
    )


def main(folder: str, *prefixes: str) -> int:
    import __spark_entry__ as entry
    from flowloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(query(spark, folder), con, sql[name])
                state = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                state = f"rows {len(query(spark, folder).collect())}"
        except Exception as e:
            state = f"FAILED {type(e).__name__} {str(e)[:400]}".replace("\n", " ")
        bad += state.startswith(("DIFFERENT", "FAILED"))
        print(f"{name:26s} {time.time() - start:6.2f} {state}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)

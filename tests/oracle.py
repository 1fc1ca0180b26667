"""Compare registered queries with their SQL on DuckDB.

``python -m tests.oracle [folder] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if value is None:
        return "NULL"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql, folder):
    """(problem or None, rows, seconds, seconds in DuckDB)."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return None, len(got), took, None
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    oracle_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took, oracle_took
    kinds = {d[0]: str(d[1]) for d in result.description}
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    a, b = table(df.columns, got), table(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"[:900], len(got), took, oracle_took
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = {c: (ours[c], kinds[c]) for c in ours if loose.get(ours[c], "?") not in kinds[c]}
    return (f"types {off}" if off else None), len(got), took, oracle_took


def main(argv):
    from inlay.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = build_session(
        "oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                 "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in argv[1:] or queries:
        try:
            problem, rows, took, other = compare(spark, con, queries[key], sqls.get(key), folder)
        except Exception as error:
            problem, rows, took, other = f"{type(error).__name__}: {str(error)[:1200]}", -1, 0.0, None
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if key in sqls else "rows")
        print(f"{mark:5}{key:28}{rows:8} {took:6.2f}s {'' if other is None else f'{other:6.2f}s'} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

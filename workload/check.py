"""Compare every query with its SQL: ``python -m workload.check [folder] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def sql_rows(connection, statement: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(statement)
    return [d[0] for d in cursor.description], cursor.fetchall()


def differences(names, rows, expected_names, expected_rows, digits: int = 9) -> str:
    """What differs between two results whatever the order of rows and columns, or ''."""
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} != {sorted(expected_names)}"
    left, right = (_canonical(n, r, digits) for n, r in
                   ((names, rows), (expected_names, expected_rows)))
    if left == right:
        return ""
    if len(left) != len(right):
        return f"{len(left)} rows, expected {len(right)}"
    first = next((a, b) for a, b in zip(left, right) if a != b)
    return f"row {first[0]} expected {first[1]}"


def _canonical(names, rows, digits):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(row[i], digits) for i in order) for row in rows), key=repr)


def _value(value, digits):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, digits) + 0.0
    return value


def main(folder: str, prefixes: list[str]) -> int:
    from stagewise.session import build_session
    from workload.oracles import all_oracles
    from workload.queries import all_queries

    spark = build_session("check", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failures = connect(folder), all_oracles(), 0
    for name, query in all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        df = query(spark, folder)
        rows = [tuple(r) for r in df.collect()]
        seconds = time.time() - started
        verdict = differences(df.columns, rows, *sql_rows(connection, oracles[name]))
        failures += bool(verdict)
        print(f"{'DIFF' if verdict else 'ok':4s} {name:34s} {len(rows):6d} {seconds:6.2f}s "
              f"{verdict}", flush=True)
    print("failures:", failures)
    spark.stop()
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(arguments[0], arguments[1:]) > 0)

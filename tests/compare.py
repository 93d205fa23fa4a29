"""Run registered queries and their SQL side by side.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def mismatch(actual, sql: str, connection) -> str | None:
    """Why the DataFrame and the SQL differ, or None."""
    columns = sorted(actual.columns)
    expected = connection.sql(sql)
    if sorted(expected.columns) != columns:
        return f"columns {columns} != {sorted(expected.columns)}"
    ours = _sorted(actual.select(*columns).collect())
    theirs = _sorted(expected.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    types = [
        (c, actual.schema[c].dataType.simpleString(), str(t))
        for c, t in zip(expected.columns, expected.types)
    ]
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    }
    wrong = [t for t in types if names[t[1]] != t[2]]
    if wrong:
        return f"types {wrong}"
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, sql = views(sf_dir), entry.oracle_sql()
    chosen = sys.argv[2:] or list(sql)  # some queries of the training-data operators have none
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            problem = mismatch(entry.queries()[name](spark, sf_dir), sql[name], connection)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} match")


if __name__ == "__main__":
    main()

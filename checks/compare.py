"""Run registered queries next to their SQL: ``python -m checks.compare [sf_dir] [names]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None if both results hold the same rows, else what differs."""
    df = registered()[name](spark, sf_dir)
    mine = sorted_rows(df.columns, df.collect())
    result = connection.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    theirs = sorted_rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if mine == theirs:
        return None
    only_mine = [row for row in mine if row not in set(theirs)][:2]
    only_theirs = [row for row in theirs if row not in set(mine)][:2]
    return f"{len(mine)} rows != {len(theirs)} rows; {only_mine} | {only_theirs}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(registered())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception:
            problem = traceback.format_exc(limit=-3)[-900:]
        failed += problem is not None
        print(f"{name} {time.time() - start:.1f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

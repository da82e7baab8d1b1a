"""Run registered queries and their SQL side by side.

``python -m checks.compare /root/testdata/sf0.01 [name ...]`` prints one line per query.
"""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, cursor.fetchall())
    if mine == theirs:
        return None
    return f"{len(mine)} and {len(theirs)} rows; {list(set(mine) - set(theirs))[:2]} {list(set(theirs) - set(mine))[:2]}"


def main(folder: str, *names: str) -> int:
    from checks.oracle_sql import ORACLES
    from checks.registered import QUERIES

    spark, con, wrong = session(), database(folder), 0
    for name in names or QUERIES:
        start = time.time()
        found = compare(QUERIES[name](spark, folder), con, ORACLES[name])
        wrong += found is not None
        print(f"{name:28s} {found or 'same'}  {time.time() - start:.2f}s", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))

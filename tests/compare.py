"""Compare the registered queries with their SQL in DuckDB.

    python tests/compare.py [data folder] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("customer", "nation", "events", "orders")


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((value is not None, str(type(value)), str(value)) for value in row)


def mismatch(df, con, sql):
    """None if both give the same columns, kinds of type and rows, else what differs."""
    names = sorted(df.columns)
    ours = sorted((tuple(row[n] for n in names) for row in df.collect()), key=_key)
    result = con.execute(sql)
    given = [column[0] for column in result.description]
    if sorted(given) != names:
        return f"columns {names} against {sorted(given)}"
    at = [given.index(n) for n in names]
    theirs = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=_key)
    if not ours:
        return "no rows"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for left, right in zip(ours, theirs, strict=True):
        for name, x, y in zip(names, left, right, strict=True):
            if type(x) is not type(y) or (x != y and not (x != x and y != y)):
                close = isinstance(x, float) and isinstance(y, float) and math.isclose(x, y)
                return f"{name}: {x!r} against {y!r}{' (close)' if close else ''} in {left}"
    return None


def main(sf_dir="/root/testdata/sf0.01", *wanted):
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert queries.keys() == oracles.keys(), queries.keys() ^ oracles.keys()
    bad = 0
    for name in wanted or queries:
        start = time.time()
        problem = mismatch(queries[name](spark, sf_dir), con, oracles[name])
        bad += problem is not None
        print(f"{name:24} {time.time() - start:6.2f} s  {problem or 'same'}", flush=True)
    print(f"{bad} of {len(wanted or queries)} differ")


if __name__ == "__main__":
    main(*sys.argv[1:])

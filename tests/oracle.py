"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

python -m tests.oracle [--sf 0.01] [--bare] [key-prefix ...]

--bare uses a session without any of the library's settings.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from granary.sources.tables import TABLES


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{root}/{name}.parquet')")
    return con


def canon(value):
    """One form per value; numbers of different kinds stay different."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, dt.datetime):
        return ("t", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(canon(v) for v in value))
    if isinstance(value, dict):
        return ("m", tuple(sorted((k, canon(v)) for k, v in value.items())))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    theirs_cols = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns: {sorted(set(df.columns) ^ set(theirs_cols))}"
    a, b = rows_of(df.columns, mine), rows_of(theirs_cols, theirs)
    if a == b:
        return None
    only_a, only_b = list((a - b).items()), list((b - a).items())
    return (f"rows {len(mine)} vs {len(theirs)}; {sum(c for _, c in only_a)} differ; columns {sorted(df.columns)}\n   spark "
            f"{only_a[:2]}\n   duck  {only_b[:2]}")


def main(args: list[str]) -> int:
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    root = f"/root/testdata/sf{sf}"
    from granary.session import local_session
    import __spark_entry__ as entry

    if args[:1] == ["--bare"]:
        args = args[1:]
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    total = 0.0
    for key, fn in queries.items():
        if args and not any(key.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, root)
            if key in oracle:
                diff = compare(df, con, oracle[key])
                word = "ok" if diff is None else "DIFF"
            else:
                diff, word = None, f"rows={df.count()}"
        except Exception as error:  # the run goes on and reports every broken query
            text = str(error).split("JVM stacktrace")[0]
            diff, word = text[:900] if "-v" not in sys.argv else traceback.format_exc(), "ERROR"
        took = time.time() - start
        total += took
        bad += diff is not None
        print(f"{word:8} {took:6.2f}s {key}" + (f"\n   {diff}" if diff else ""), flush=True)
    print(f"bad={bad} total={total:.1f}s")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:] if a != "-v"]) else 0)

"""Run catalog queries and their SQL side by side.

python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf{sf}/{name}.parquet'")
    return con


def _rows(table) -> Counter:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(map(repr, zip(*columns))) if columns else Counter()


def difference(got, want) -> str:
    """'' when both Arrow tables hold the same rows, else what differs."""
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    kinds = {}
    for n in got.column_names:
        a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            kinds[n] = (a, b)
    if kinds:
        return f"types {kinds}"
    a, b = _rows(got), _rows(want)
    if a != b:
        extra, lost = a - b, b - a
        return (
            f"{got.num_rows} rows, expected {want.num_rows}; only here "
            f"{[k[:300] for k in list(extra)[:2]]}; only there {[k[:300] for k in list(lost)[:2]]}"
        )
    return ""


def arrow(con, sql: str):
    return con.sql(sql).to_arrow_table()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    from feedloom.session import ROCKSDB_PROVIDER

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import catalog

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(catalog.QUERIES)
    spark, con, bad = session(), oracle(sf), 0
    for name in names:
        start = time.time()
        try:
            got = catalog.QUERIES[name](spark, f"{DATA}/sf{sf}").toArrow()
            took = time.time() - start
            if name in catalog.SQL:
                problem = difference(got, arrow(con, catalog.SQL[name]))
                state = "ok" if not problem else "DIFF"
            else:
                problem, state = "", "rows"
        except Exception as e:
            took, problem, state = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", "FAIL"
        bad += bool(problem)
        rows = got.num_rows if state in ("ok", "rows", "DIFF") else "-"
        print(f"{state:5} {name:28} {took:6.2f}s {rows} {problem}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Run registered queries next to their SQL in DuckDB and compare the rows.

python tests/compare.py [scale factor folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None):
    """(problem or None, row count, seconds in Spark)"""
    start = time.time()
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return None, len(got), spent
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}", len(got), spent
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} / {len(want)}; only here {extra}; only SQL {lacking}", len(got), spent
    return None, len(got), spent


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "OFF")
        .getOrCreate()
    )
    con = duck(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        try:
            problem, n, spent = compare(spark, con, sf_dir, name, query, sql.get(name))
        except Exception as error:  # show every failure, not only the first
            problem, n, spent = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in sql else "rows")
        print(f"{mark} {name:40s} {n:8d} rows {spent:6.2f}s {problem or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with their SQL: ``python -m tests.oracle_check [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.10g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    con.close()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not got:
        return "no rows"
    if got != want:
        extra, missing = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
        return f"{len(got)} rows vs {len(want)}; extra {extra}; missing {missing}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = compare(spark, sf_dir, name, queries[name], oracle[name])
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad, "of", len(sys.argv[2:] or queries), "missing sql:", set(queries) - set(oracle))


if __name__ == "__main__":
    main()

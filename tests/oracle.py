"""Compare a Spark result with DuckDB running the SQL twin on the same files.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def kinds(rows, columns):
    out = {}
    for i, c in enumerate(columns):
        out[c] = sorted({type(r[i]).__name__ for r in rows if r[i] is not None})
    return out


def compare(spark_df, con, sql):
    """Empty string when equal, else what differs."""
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}", len(got)
    _, a = canonical(spark_df.columns, got)
    _, b = canonical(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:3]
        only_b = [x for x in b if x not in sa][:3]
        return (
            f"rows {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}\n"
            f"   types {kinds(got, spark_df.columns)} vs {kinds(want, names)}"
        ), len(got)
    return "", len(got)


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("starlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    root = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        root, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    spark, con = session(), duck(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, root)
            if name in oracles:
                diff, n = compare(df, con, oracles[name])
            else:
                diff, n = "", len(df.collect())
            status = "ok  " if not diff else "DIFF"
            if name not in oracles:
                status = "rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, n, status = f"{type(e).__name__}: {str(e)[:1500]}", -1, "ERR "
        failed += status in ("DIFF", "ERR ")
        print(f"{status} {name:45s} {n:7d} rows {time.time() - t:6.2f}s", flush=True)
        if diff:
            print("   " + diff, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Run registered queries on Spark and DuckDB and compare the whole results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowwatch")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    import numpy as np
    if v is None:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "NULL"
        return f"{v + 0.0:.9g}"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    kinds = {c[0]: str(c[1]) for c in res.description}
    for f, k in df.dtypes:
        a = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}.get(k)
        if a and kinds[f] not in (a,):
            print(f"   type note {name}.{f}: spark {k}, duckdb {kinds[f]}")
    a, b = table_rows(df.columns, got), table_rows(cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; spark {bad[0][0]} sql {bad[0][1]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    names = [a for a in argv if not a.startswith("/") and not a.isdigit()]
    for a in argv:
        if a.isdigit():  # rows one task may sort: a small number drives the split paths
            from flowwatch.operators import order
            order.TASK_ROWS = int(a)
    spark = spark_session()
    con = duck(sf)
    qs, sql = queries(), oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, fn, sql.get(name), sf)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:6000]}"
        state = "ok" if diff is None else "BAD " + diff
        if diff:
            bad.append(name)
        print(f"{name:32s} {time.time() - t:6.2f}s {'' if name in sql else '(rows) '}{state}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

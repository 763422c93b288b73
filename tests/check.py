"""Run registered queries beside their SQL form and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'") if False else None
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return float(f"{x:.10g}") + 0.0
    if isinstance(x, (int, str)):
        return x
    return repr(x)


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(name: str, df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = df.collect()
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} want {sorted(cols)}"
    order = sorted(cols)
    gi = [df.columns.index(c) for c in order]
    wi = [cols.index(c) for c in order]
    a = sorted((tuple(_cell(r[i]) for i in gi) for r in got), key=_key)
    b = sorted((tuple(_cell(r[i]) for i in wi) for r in want), key=_key)
    if len(a) != len(b):
        return f"{name}: {len(a)} rows, want {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
    if bad:
        return f"{name}: {len(bad)} of {len(a)} rows differ over {order}; first {bad[0][0]} want {bad[0][1]}"
    if not a:
        return f"{name}: empty"
    return None


def session(cpus: int = 8, shuffle: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("paywarden")
            .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.extraJavaOptions", "-Dlog4j2.level=ERROR").getOrCreate())


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    folder = sys.argv[1]
    q, o = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(q)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for n in names:
        t = time.time()
        try:
            df = q[n](spark, folder)
            if n in o:
                t1 = time.time()
                msg = compare(n, df, con, o[n])
            else:
                rows = df.collect()
                msg = f"(no sql) {len(rows)} rows e.g. {rows[:1]}"
        except Exception as ex:  # noqa: BLE001
            msg = f"{n}: ERROR {str(ex)[:700]}"
        print(f"{time.time() - t:6.1f}s {n}: {'ok' if msg is None else msg}", flush=True)

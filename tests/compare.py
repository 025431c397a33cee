"""Runs queries beside their SQL on the driver's tables and compares the rows. As a script: python -m tests.compare [--sf DIR] [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str = SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _cell(v):
    import datetime as dt
    import decimal

    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(v.normalize())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, df, sql: str) -> str:
    got = rows_of(df.columns, [tuple(x.asDict(True).values()) for x in df.collect()])
    rel = con.sql(sql)
    names = list(rel.columns)
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}; " + str([x for x in got if x not in want][:2]) + " / " + str([x for x in want if x not in got][:2])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    sf = args[1] if args[:1] == ["--sf"] else SF
    args = args[2:] if args[:1] == ["--sf"] else args
    q, o = e.queries(), e.oracle_sql()
    names = [n for n in q if not args or any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in args)]
    spark, con, bad = spark_session(), duck(sf), 0
    for n in names:
        t = time.time()
        try:
            said = compare(spark, con, q[n](spark, sf), o[n]) if n in o else f"-- {q[n](spark, sf).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:900]}"
        if said and not said.startswith("--"):
            bad += 1
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Side-by-side run of registered queries: Spark against DuckDB on the same files."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "to_pydatetime"):
        return str(v)
    return _cell(v) if isinstance(v, float) else v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted((tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False)), key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from marquee.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8, driver_memory="16g",
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    failed = 0
    for name in names:
        started = time.time()
        try:
            out = queries[name](spark, folder).toPandas()
            took = time.time() - started
            started = time.time()
            problem = None
            if name in sql:
                problem = compare(out, con.sql(sql[name]).df())
            verdict = "ok" if problem is None else "DIFF " + problem[:600]
            if name not in sql:
                verdict = "rows-only"
            print(f"{name:28s} {len(out):8d} rows {took:6.2f}s duck {time.time() - started:5.2f}s {verdict}", flush=True)
            failed += problem is not None
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"{name:28s} ERROR {str(e)[:700]}", flush=True)
    print("failed:", failed)

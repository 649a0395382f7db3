"""Side-by-side run of registered queries and their SQL: python tests/parity.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contestry")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return v
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def table_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    )


def compare(spark_rows, spark_names, duck_rows, duck_names) -> str:
    sn, sr = table_of(spark_rows, spark_names)
    dn, dr = table_of(duck_rows, duck_names)
    if sn != dn:
        return f"columns differ: {sn} vs {dn}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr, strict=True) if [repr(x) for x in a] != [repr(x) for x in b]]
    if not bad:
        return "ok"
    close = all(
        all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-5)
            for x, y in zip(a, b, strict=True)
        )
        for a, b in bad
    )
    return f"{'CLOSE' if close else 'VALUES'} {len(bad)} of {len(sr)} rows, e.g. {bad[0][0]} vs {bad[0][1]}"


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    qs, sql = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not names or any(n.startswith(p) for p in names)]
    spark, con = session(), duck(folder)
    failed = 0
    for n in picked:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if n in sql:
                cur = con.execute(sql[n])
                cols = [d[0] for d in cur.description]
                types = [str(d[1]) for d in cur.description]
                msg = compare(rows, df.columns, cur.fetchall(), cols)
                if any("HUGEINT" in t or "DECIMAL" in t for t in types):
                    msg += f" [types {dict(zip(cols, types, strict=True))}]"
            else:
                msg = f"rows only: {len(rows)}"
            failed += not msg.startswith(("ok", "rows"))
            print(f"{n:32s} {t1 - t0:6.2f}s {time.time() - t1:6.2f}s  {msg[:400]}", flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{len(picked)} queries, {failed} not equal")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)

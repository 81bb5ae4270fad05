"""Local twin of the driver's correctness gate: Spark query vs DuckDB SQL.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "<null>"
    if isinstance(v, float) and v.is_integer() and abs(v) < 2 ** 53:
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        return f"{r + 0.0:.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm_value(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm_value(x) for x in v) + "]"
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return _norm_value(float(v))
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm_value(v) for v in rec) for rec in df[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return False, f"columns differ: {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return False, f"rows differ: {len(spark_df)} vs {len(duck_df)}"
    a, b = canonical(spark_df), canonical(duck_df)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {bad}"
    return True, f"{len(a)} rows"


def main(argv):
    from churnforge.session import get_spark
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not os.path.isdir(a)]
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failures = 0
    for key, fn in qs.items():
        if keys and key not in keys:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as exc:  # report and continue
            failures += 1
            print(f"FAIL {key}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            continue
        t1 = time.time()
        if key not in sqls:
            print(f"ROWS {key}: {len(sdf)} rows (no oracle) {t1 - t0:.2f}s")
            continue
        try:
            ddf = con.execute(sqls[key]).df()
        except Exception as exc:
            failures += 1
            print(f"FAIL {key}: duckdb error {str(exc)[:400]}")
            continue
        ok, msg = compare(sdf, ddf)
        failures += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {key}: {msg} spark {t1 - t0:.2f}s")
    print(f"failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

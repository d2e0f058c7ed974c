"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/compare.py [--sf /root/testdata/sf0.01] [name-substring ...]
"""
from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.sources.tables import TABLES  # noqa: E402


def norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    if isinstance(v, (list, tuple, dict)):
        return repr(v)
    return v


def rows_of(tbl):
    """``tbl`` is a pyarrow Table."""
    cols = sorted(tbl.column_names)
    data = {c: tbl.column(c).to_pylist() for c in cols}
    out = [tuple(norm(data[c][i]) for c in cols) for i in range(tbl.num_rows)]
    return cols, sorted(out, key=lambda t: repr(t))


def digest(rows):
    h = hashlib.sha256()
    for t in rows:
        h.update(repr(t).encode())
    return h.hexdigest()[:16]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tidemark.session import get_spark
    from tidemark.plans.catalog import load_all
    spark = get_spark("local[8]", 8)
    reg = load_all()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for name, e in sorted(reg.items()):
        if a.names and not any(s in name for s in a.names):
            continue
        t0 = time.time()
        try:
            sdf = e.fn(spark, a.sf).toArrow()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(ex)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"rows-only {name}: {sdf.num_rows} rows {ts:.1f}s")
            continue
        try:
            ddf = con.execute(e.sql).to_arrow_table()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(ex)[:800]}")
            bad += 1
            continue
        sc, sr = rows_of(sdf)
        dc, dr = rows_of(ddf)
        if sc != dc:
            print(f"MISMATCH-COLS {name}: spark={sc} duck={dc}")
            bad += 1
            continue
        if len(sr) != len(dr):
            print(f"MISMATCH-ROWS {name}: spark={len(sr)} duck={len(dr)}")
            bad += 1
            continue
        if digest(sr) != digest(dr):
            diffs = [(x, y) for x, y in zip(sr, dr) if x != y][:3]
            print(f"MISMATCH-VALUES {name}: cols={sc}\n   first diffs: {diffs}")
            bad += 1
            continue
        print(f"ok {name}: {len(sr)} rows {ts:.1f}s")
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()

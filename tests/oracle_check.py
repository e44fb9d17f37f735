"""Run queries() against oracle_sql() in DuckDB, the way the driver's correctness gate does.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v) if not isinstance(v, (int, bool)) else v


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest()[:12]


def main(argv):
    import duckdb
    import __spark_entry__ as entry
    from ebbtide.session import build_session
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    if "--plain" in argv:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        argv = [a for a in argv if a != "--plain"]
        names = [a for a in names if a != "--plain"]
    else:
        spark = build_session()
    for a in list(argv):
        if a.startswith("--tz="):
            spark.conf.set("spark.sql.session.timeZone", a.split("=", 1)[1])
            argv.remove(a)
            names = [n for n in names if n != a]
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        ok_h = ok_cols and digest(srows, scols) == digest(drows, dcols)
        status = "ok  " if (ok_cols and ok_n and ok_h) else "FAIL"
        if status == "FAIL":
            bad += 1
        print(f"{status} {name}: spark {len(srows)} duck {len(drows)} cols={ok_cols} hash={ok_h} {ts:.2f}s")
        if status == "FAIL" and ok_cols and ok_n:
            order = sorted(range(len(scols)), key=lambda i: scols[i])
            dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
            a = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in srows)
            b = sorted(repr(tuple(_norm(r[i]) for i in dorder)) for r in drows)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print("   cols:", [scols[i] for i in order])
            for x, y in diff:
                print("   spark:", x[:300])
                print("   duck :", y[:300])
        elif not ok_cols:
            print("   spark cols:", scols, "\n   duck cols:", dcols)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

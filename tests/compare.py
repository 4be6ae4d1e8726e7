"""Run a registered query and its oracle on the same folder and compare schema and rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    t1 = time.time()
    if sql is None:
        return False, f"rows={len(got)} no oracle spark={t1 - t0:.1f}s"
    desc = dict((r[0], r[1]) for r in con.execute(f"describe {sql}").fetchall())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    exp = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key) if sorted(names) == cols else None
    t2 = time.time()
    if exp is None:
        return False, f"columns {cols} != {sorted(names)}"
    kinds = [(c, t, desc[c]) for c, t in df.dtypes if TYPES.get(t, t) != desc[c] and desc[c] != "\"NULL\""]
    if kinds:
        return False, f"types {kinds} rows_equal={got == exp}"
    if got != exp:
        a, b = set(got) - set(exp), set(exp) - set(got)
        return False, f"rows {len(got)} vs {len(exp)}; only spark {sorted(a, key=key)[:3]}; only oracle {sorted(b, key=key)[:3]} cols {cols}"
    return True, f"rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tests.conftest import make_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = make_session()
    con = duck(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg = compare(spark, con, name, q[name], o.get(name), sf)
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failures", bad)
    spark.stop()


if __name__ == "__main__":
    main()

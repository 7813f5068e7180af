"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return f"{f:.9g}" if f else "0"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}\n   only spark {extra}\n   only sql   {missing}\n   cols {sorted(names)}"
    return True, f"{len(got)} rows"


def main(argv):
    from storelens.session import build_session
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    prefixes = tuple(argv[1:])
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    checks = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            if name in checks:
                ok, note = compare(fn(spark, sf), con, checks[name])
            else:
                n = fn(spark, sf).count()
                ok, note = True, f"{n} rows (no sql)"
        except Exception as ex:  # report every failing query of the run
            ok, note = False, str(ex)[:1500]
        if ok and note.startswith("0 rows"):
            note += "  EMPTY"
        print(("ok   " if ok else "FAIL ") + f"{name} {time.time() - t0:.1f}s {note}", flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

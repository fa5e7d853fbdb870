"""Compare registered queries with their oracle SQL.  usage: check.py [sf] [name-substring ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidegauge import catalog  # noqa: E402
from tidegauge.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"f{value:.6f}"
    return f"{type(value).__name__[0]}{value}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    mods = [p[4:] for p in picks if p.startswith("mod:")]
    picks = [p for p in picks if not p.startswith("mod:")]
    if mods:
        catalog._MODULES = tuple(mods)
    catalog.load()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, fn in list(catalog.QUERIES.items()):
        if picks and not any(p in name for p in picks):
            continue
        try:
            t0 = time.time()
            got_df = fn(spark, folder)
            cols = sorted(got_df.columns)
            got = sorted(tuple(norm(r[k]) for k in cols) for r in got_df.collect())
            took = time.time() - t0
            if name not in catalog.ORACLES:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            t0 = time.time()
            res = con.execute(catalog.ORACLES[name])
            names = [d[0] for d in res.description]
            raw = res.fetchall()
            sql_took = time.time() - t0
            order = [names.index(k) for k in cols] if sorted(names) == cols else None
            if order is None:
                print(f"BAD   {name}: columns spark={cols} sql={sorted(names)}", flush=True)
                bad += 1
                continue
            want = sorted(tuple(norm(r[i]) for i in order) for r in raw)
            if got == want:
                print(f"ok    {name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
            else:
                bad += 1
                print(f"BAD   {name}: spark {len(got)} rows, sql {len(want)} rows; columns {cols}", flush=True)
                a = [g for g in got if g not in set(want)][:3]
                b = [w for w in want if w not in set(got)][:3]
                for row in a:
                    print("   spark", row)
                for row in b:
                    print("   sql  ", row)
        except Exception as err:  # report and go on with the next query
            bad += 1
            print(f"ERR   {name}: {type(err).__name__} {str(err)[:1200]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

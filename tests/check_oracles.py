"""Compare registered queries with their oracles: ``python tests/check_oracles.py [sf] [name prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
                out.append("")
            elif hasattr(v, "__len__") and not isinstance(v, str):
                out.append(str(list(v)))
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, str):
                out.append(v)
            else:
                try:
                    out.append(f"{float(v) + 0.0:.6f}")
                except (TypeError, ValueError):
                    out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    import __spark_entry__ as E
    from pitchline.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            flags = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if w in plan]
            got = df.toPandas()
            took = time.time() - start
            if flags:
                print(f"plan  {name}: {flags}")
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s")
                continue
            want = con.execute(oracles[name]).df()
            a, b = canonical(got), canonical(want)
            same = sorted(got.columns) == sorted(want.columns) and a == b
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)} rows {took:.1f}s")
            if not same:
                bad += 1
                print("  columns", sorted(got.columns), sorted(want.columns), "rows", len(a), len(b))
                print("  spark only ", list(sorted(set(a) - set(b)))[:3], "\n  oracle only", list(sorted(set(b) - set(a)))[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(e)[:1500]}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

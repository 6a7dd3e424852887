"""Run queries in Spark and their SQL in DuckDB, and compare the rows: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.queries import ORACLES, QUERIES
from checks.views import TABLES
from palisade.session import build_session


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def main(sf: str, names: list[str]) -> int:
    folder = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            left_columns, left = _bag(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: spark: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {sum(left.values())} rows {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(ORACLES[name])
            right_columns, right = _bag([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: duckdb: {str(e)[:1500]}", flush=True)
            continue
        if left_columns != right_columns or left != right:
            bad += 1
            print(f"DIFF {name}: {left_columns} {right_columns} rows {sum(left.values())} vs {sum(right.values())}")
            for r in list((left - right).items())[:3]:
                print("   spark ", r)
            for r in list((right - left).items())[:3]:
                print("   duckdb", r)
            sys.stdout.flush()
        else:
            print(f"ok   {name}: {sum(left.values())} rows {took:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["0.01"]
    sys.exit(1 if main(args[0], args[1:]) else 0)

"""Run registered queries next to their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql) -> tuple[str, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows-only ({len(got)})", took
    result = con.execute(sql)
    want_names, want = rows([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", took
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} vs {want[:2]}", took
    for a, b in zip(got, want):
        if a != b:
            return f"row {str(a)[:400]} != {str(b)[:400]}", took
    return "ok" if got else "ok (empty)", took


def main(argv):
    import __spark_entry__ as entry
    from facetwise.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark, con = local_session("8"), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        try:
            verdict, took = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as exc:
            verdict, took = f"FAILED {type(exc).__name__}: {str(exc)[:500]}", 0.0
        good = verdict.startswith(("ok", "rows-only"))
        bad += not good
        print(f"{name:32} {took:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

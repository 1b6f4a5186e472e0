"""Runs named queries in Spark and their SQL in DuckDB and compares the tables exactly."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(want)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    kinds = {c: str(t) for c, t in zip(cols, [d[1] for d in res.description])}
    spark_kinds = dict(df.dtypes)
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (spark_kinds[c], kinds[c]) for c in cols if alias.get(spark_kinds[c]) != kinds[c]}
    return f"types differ: {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(args.sf), queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            note = compare(df, con, sqls[name]) if name in sqls else None
            extra = "" if name in sqls else f" rows={df.count()}"
        except Exception as e:  # report and go on
            note, extra = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {name} {time.time() - start:.1f}s{extra} {note or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())

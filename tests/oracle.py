"""Run a registered query and its SQL twin on the same tables and compare the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) if math.isfinite(v) else False:
            return int(v)
        return v
    if isinstance(v, int):
        return v
    return str(v)


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None when both agree, else a description of the first difference."""
    df = query(spark, sf_dir)
    got_names, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = table_rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns differ: only here {set(got_names) - set(want_names)}, only SQL {set(want_names) - set(got_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows here, {len(want)} in SQL"
    for g, w in zip(got, want, strict=True):
        if g != w:
            bad = [(n, a, b) for n, a, b in zip(got_names, g, w, strict=True) if a != b]
            n_bad = sum(x != y for x, y in zip(got, want, strict=True))
            return f"{n_bad} rows differ, e.g. {bad[:4]} in {g[:3]}"
    return None


def main() -> int:
    from riskweave.queries import ORACLES, QUERIES
    from riskweave.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session(8, int(os.environ.get("PARTITIONS", "8")))
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                problem = None
                note = f"rows only: {len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            problem = "error"
            note = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

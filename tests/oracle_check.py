"""Compare registered queries with their DuckDB SQL. Usage: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from groundloom.plans.fixtures import TABLES  # noqa: E402

DATA = os.environ.get("GROUNDLOOM_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return f"f:{v!r}"
    if isinstance(v, datetime.datetime):
        return f"t:{v.replace(tzinfo=None).isoformat()}"
    return f"{type(v).__name__}:{v}"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None when equal, otherwise a description of the difference."""
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = normal([tuple(r) for r in df.collect()], got_cols)
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = normal(rel.fetchall(), want_cols)
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2] if len(got) < 50000 else []
        missing = [x for x in want if x not in set(got)][:2] if len(want) < 50000 else []
        return f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {missing}"[:1500]
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        cols = sorted(got_cols)
        diff = {c: (x[:300], y[:300]) for c, x, y in zip(cols, a, b) if x != y}
        return f"{len(bad)} of {len(got)} rows differ, first: {a[:2]} {diff}"[:1800]
    return None if got else "EMPTY (equal but no rows)"


def main() -> None:
    from groundloom.plans import load
    from groundloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{DATA}/sf{sf}"
    queries, oracles = load()
    names = sys.argv[2:] or list(queries)
    names = [n for p in names for n in queries if n == p or (p.endswith("*") and n.startswith(p[:-1]))] if sys.argv[2:] else names
    spark = local_session(8)
    con = duck(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in oracles:
                res = compare(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                res = f"no sql, {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        ok = res is None or res.startswith("no sql")
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {res or ''}", flush=True)
    print(f"{len(names) - failed} ok, {failed} bad")


if __name__ == "__main__":
    main()

"""Side-by-side comparison of a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _same(a, b, tolerance: float) -> bool:
    """Equal, or floats within the last rounded digit (a value that lies exactly on a rounding tie)."""
    return a == b or (tolerance > 0 and all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance) for x, y in zip(a, b)))


def compare(df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    """Problems found; empty when rows, names, types and values agree."""
    import time
    problems = []
    t0 = time.time()
    con.execute(f"DESCRIBE {sql}")
    described = {r[0]: r[1] for r in con.fetchall()}
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs_raw = cur.fetchall()
    compare.sql_seconds = time.time() - t0
    cols = sorted(df.columns)
    if cols != sorted(names):
        return [f"columns {cols} vs {sorted(names)}"]
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString())
        if want and described[f.name] != want:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} vs {described[f.name]}")
    ours_raw = df.select(*[f"`{c}`" for c in cols]).collect()
    key = lambda row: tuple((v is not None, str(type(v)), v) for v in row)
    ours = sorted((tuple(_norm(v) for v in r) for r in ours_raw), key=repr)
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in at) for r in theirs_raw), key=repr)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if not _same(a, b, tolerance)]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {cols}\n   {bad[0][0]}\n   {bad[0][1]}")
    if not ours:
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from counterlens.session import build_session

    sf = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", cores=8, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as exc:  # report and go on
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        print(("ok  " if not problems else "FAIL"), name, f"{time.time() - t:.1f}s (sql {getattr(compare, 'sql_seconds', 0):.1f}s)",
              "" if name in oracles else "(rows only)", flush=True)
        for p in problems:
            print("     ", p, flush=True)
        if problems:
            failed.append(name)
        spark.catalog.clearCache()
    print("failed:", failed)

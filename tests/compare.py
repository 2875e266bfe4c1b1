"""Compares every registered query with its DuckDB text on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows):
    out = {}
    for r in rows:
        for i, v in enumerate(r):
            if v is not None:
                out.setdefault(i, set()).add(type(v).__name__)
    return out


def check(spark, con, sf_dir, name, queries, oracles):
    """(ok, message) for one query."""
    t = time.time()
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if name not in oracles:
        return len(got) > 0, f"{len(got)} rows, no oracle, {took:.1f}s"
    cur = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if kinds(got) != kinds(want):
        diff = {got_cols[i]: (kinds(got).get(i), kinds(want).get(i)) for i in range(len(got_cols))
                if kinds(got).get(i) != kinds(want).get(i)}
        if got != want or diff:
            return False, f"types {diff} rows {len(got)} vs {len(want)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}\n   got  {extra}\n   want {lack}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{len(bad)} of {len(got)} rows differ {got_cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    if not got:
        return False, "no rows"
    return True, f"{len(got)} rows, {took:.1f}s"


def main():
    import sys

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from vacantry.session import local_session

    sf = next((a for a in sys.argv[1:] if a.startswith("sf")), "sf0.01")
    want = [a for a in sys.argv[1:] if not a.startswith("sf")]
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = queries(), oracle_sql()
    failed = 0
    for name in q:
        if want and not any(w in name for w in want):
            continue
        try:
            ok, msg = check(spark, con, sf_dir, name, q, o)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()

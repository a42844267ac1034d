"""Run registered queries in Spark and their SQL in DuckDB; compare results.

Columns are sorted by name, rows by all values; non-float values must be
equal, floats equal exactly (``strict``) or within a relative tolerance.
Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, v)
    if hasattr(v, "isoformat"):
        return (2, v.isoformat())
    return (3, str(v))


def compare(spark_df, con, sql: str, rel_tol: float = 0.0):
    """Return None when equal, else a short reason."""
    s_rows = [r.asDict() for r in spark_df.collect()]
    d_rel = con.sql(sql)
    d_cols = d_rel.columns
    d_rows = [dict(zip(d_cols, r)) for r in d_rel.fetchall()]
    s_cols = sorted(spark_df.columns)
    if s_cols != sorted(d_cols):
        return f"columns differ: spark={s_cols} sql={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return f"row count spark={len(s_rows)} sql={len(d_rows)}"

    def key(r):
        return tuple(_norm(r[c]) for c in s_cols)
    s_sorted = sorted(s_rows, key=lambda r: tuple((k[0], str(k[1])) for k in key(r)))
    d_sorted = sorted(d_rows, key=lambda r: tuple((k[0], str(k[1])) for k in key(r)))
    worst = 0.0
    for a, b in zip(s_sorted, d_sorted):
        for c in s_cols:
            x, y = _norm(a[c]), _norm(b[c])
            if x == y:
                continue
            if x[0] == 1 and y[0] == 1:
                rel = abs(x[1] - y[1]) / max(1e-300, abs(x[1]), abs(y[1]))
                worst = max(worst, rel)
                if rel <= rel_tol:
                    continue
                return f"value {c}: spark={a[c]!r} sql={b[c]!r} (rel {rel:.2e})"
            if x[0] in (1, 3) and y[0] in (1, 3):
                try:
                    if float(x[1]) == float(y[1]):
                        continue
                except (TypeError, ValueError):
                    pass
            return f"value {c}: spark={a[c]!r} sql={b[c]!r}"
    return None


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    from ledgerlens.plans.registry import all_oracles, all_queries
    from ledgerlens.plans.runtime import get_session
    spark = get_session()
    qs, sqls = all_queries(), all_oracles()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                reason = compare(df, con, sqls[name])
            else:
                reason = f"rows-only: {df.count()} rows"
        except Exception as e:  # report and continue
            reason = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        ok = reason is None or reason.startswith("rows-only")
        bad += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {reason or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

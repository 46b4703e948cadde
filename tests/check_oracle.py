"""Run registered queries next to their DuckDB SQL: ``python tests/check_oracle.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    if isinstance(v, (bool, int)):
        return v
    return v


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=lambda r: repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)))


def signed_zero(v):
    return isinstance(v, float) and v == 0 and math.copysign(1, v) < 0


def same(a, b, depth=0):
    """Equality of two rows. The driver's hash tells zeros by their sign inside arrays (depth 2), not in plain columns."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, depth + 1) for x, y in zip(a, b))
    if isinstance(a, float) or isinstance(b, float):
        if depth > 1 and signed_zero(a) != signed_zero(b):
            return False
        try:
            return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
        except TypeError:
            return a == b
    return a == b


def compare(spark, con, entry, sf):
    t0 = time.time()
    df = entry.run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t0
    if entry.sql is None:
        return "rows-only", len(got), dt, ""
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), dt, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    ex = sum(x == y for x, y in zip(a, b))
    if len(a) != len(b) or not all(same(x, y) for x, y in zip(a, b)):
        bad = [(x, y) for x, y in zip(a, b) if not same(x, y)][:2]
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return "DIFF", len(got), dt, f"{len(a)} vs {len(b)} first {bad} only-spark {list(sa - sb)[:2]} only-duck {list(sb - sa)[:2]}"
    kinds = {"DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}
    dts = dict(df.dtypes)
    odd = [f"{c}:{dts[c]}/{t}" for c, t in zip(cols, types) if kinds.get(t, dts[c]) != dts[c] or t in ("HUGEINT",) or t.startswith("DECIMAL")]
    note = (f"types {odd}" if odd else "") + (f" exact {ex}/{len(a)}" if ex != len(a) else "")
    return "ok", len(got), dt, note


def main():
    from eventloom.plans import registry
    from eventloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    entries = registry.load()
    names = args or list(entries)
    names = [n for n in entries if any(n == a or (a.endswith("*") and entries[n].run.__name__ and n.startswith(a[:-1])) for a in names)] if args else names
    spark, con = local_session(int(os.environ.get("CORES", "8"))), connect(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, entries[n], sf)
        except Exception as e:  # noqa: BLE001
            r = ("ERROR", 0, 0.0, str(e)[:600].replace("\n", " "))
        bad += r[0] not in ("ok", "rows-only")
        print(f"{n:28s} {r[0]:9s} rows={r[1]:<7d} {r[2]:6.2f}s {r[3]}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()

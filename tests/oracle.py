"""Run registered queries next to their SQL on the same parquet files and compare the rows.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from motoquant.plans.standins import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v) if v is not None else None


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    note = ""
    same = {"varchar": "string", "integer": "int", "timestamp": "timestamp_ntz"}
    odd = {n: (got_types[n], types[n]) for n in names if same.get(types[n], types[n]) != got_types[n]}
    if odd:
        note = f" types differ {odd}"
    if a != b:
        only_a, only_b = a - b, b - a
        cols = sorted(names)
        return False, (
            f"rows {len(got)} vs {len(want)}, {sum(only_a.values())} differ {cols}"
            f"\n   spark {list(only_a)[:3]}\n   sql   {list(only_b)[:3]}{note}"
        )
    return True, f"{len(got)} rows{note}"


def main() -> int:
    import __spark_entry__ as entry
    from motoquant.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        args = args[:i] + args[i + 2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, query in queries.items():
        if args and not any(name.startswith(p) for p in args):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, msg = compare(spark, con, query, sqls[name], sf_dir)
            else:
                ok, msg = True, f"{len(query(spark, sf_dir).collect())} rows (no SQL)"
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

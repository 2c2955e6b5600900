"""Run registered queries against their oracle SQL and compare the values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One comparable form per value; kinds stay apart, so 1 and 1.0 do not compare equal."""
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"dec {value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}f"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(plain(row[i]) for i in order) for row in rows)


def check(spark, con, folder, name, query, sql):
    """(matches, message)"""
    started = time.perf_counter()
    frame = query(spark, folder)
    got = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.perf_counter() - started
    if sql is None:
        return True, f"{len(got[1])} rows, no oracle, {spent:.1f}s"
    cursor = con.execute(sql)
    want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"rows {len(got[1])}/{len(want[1])} spark-only {extra} oracle-only {missing}"
    return True, f"{len(got[1])} rows, {spent:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallyhouse.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con, bad = local_session(8), duck(folder), 0
    statements = oracle_sql()
    for name, query in queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        try:
            good, message = check(spark, con, folder, name, query, statements.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            good, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "FAIL", name, message, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

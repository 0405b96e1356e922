"""Run registered queries next to their SQL and compare: ``python tools/check.py [sf_dir] [name...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from listinglake.catalog import ORACLES, QUERIES  # noqa: E402
from listinglake.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def text(value) -> str:
    if isinstance(value, float):
        return f"{value:.6g}" if value == value else "None"
    return str(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if name not in ORACLES:
        return True, f"{took:6.2f}s {len(rows)} rows (no SQL)"
    cursor = con.execute(ORACLES[name])
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    mine, theirs = normalised(df.columns, rows), normalised(expected_columns, expected)
    if mine == theirs:
        return True, f"{took:6.2f}s {len(rows)} rows"
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} vs {theirs[0]}"
    a, b = set(mine[1]), set(theirs[1])
    return False, f"{len(rows)} vs {len(expected)} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(8), database(sf_dir), 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as problem:  # noqa: BLE001
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:700]}"
        failed += not ok
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries beside their SQL in DuckDB and compare the values.

    python tests/check_oracle.py [sf directory] [query …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in entry.TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def comparable(columns: list[str], rows: list) -> list[str]:
    """Rows as sorted texts, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "NaN" if math.isnan(value) else repr(value)
        if isinstance(value, int) and not isinstance(value, bool):
            return repr(value)
        return str(value)

    return sorted("|".join(cell(row[i]) for i in order) for row in rows)


def check(spark, con, sf: str, name: str) -> tuple[bool, int, float]:
    """True if the query and its SQL give the same columns and rows."""
    started = time.time()
    result = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in result.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(rows) > 0, len(rows), seconds
    expected = con.execute(sql)
    columns = [d[0] for d in expected.description]
    same = sorted(columns) == sorted(result.columns) and comparable(
        columns, expected.fetchall()
    ) == comparable(result.columns, rows)
    return same, len(rows), seconds


def main() -> int:
    from conftest import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = session(), connect(sf), 0
    for name in names:
        try:
            same, rows, seconds = check(spark, con, sf, name)
            verdict = "ok" if same else "DIFFERS"
        except Exception as error:
            same, rows, seconds, verdict = False, -1, 0.0, f"FAILED {str(error)[:600]}"
        bad += not same
        oracle = "" if name in entry.oracle_sql() else "(rows only)"
        print(f"{name:32s} {rows:8d} rows {seconds:7.2f} s  {verdict} {oracle}", flush=True)
    print(f"{len(names) - bad} of {len(names)} hold")
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Run the registered queries next to their SQL: python -m verification.check SF_DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from crawlgauge.plans.session import build_session
from verification.registry import ORACLE, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return f"rows only ({len(got[1])})"
    cur = con.execute(ORACLE[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lacking = [r for r in want[1] if r not in set(got[1])][:2]
        return f"ROWS {len(got[1])} vs {len(want[1])}\n   spark {extra}\n   sql   {lacking}"
    return f"ok ({len(got[1])} rows)"


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

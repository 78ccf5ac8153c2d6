"""Run check queries and compare them with their oracles: python -m checks.verify [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks import ORACLES, QUERIES
from sitefold.session import build_session


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def oracle_rows(sf: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def compare(spark, sf: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return bool(got), f"{len(got)} rows, no oracle"
    columns, want = oracle_rows(sf, ORACLES[name])
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {df.columns} vs {columns}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b and got:
        return True, f"{len(got)} rows"
    return False, (
        f"{len(got)} vs {len(want)} rows; columns {sorted(columns)}\n"
        f"  only Spark: {list((a - b))[:3]}\n  only oracle: {list((b - a))[:3]}"
    )


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "verify", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, sf, name)
        except Exception as error:  # a failing query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())

"""Run registered queries against DuckDB on the same files and compare every value.

``python tests/oracle.py [-d DIR] [PREFIX ...]``
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandline.plans.fixtures import GIVEN  # noqa: E402
from strandline.plans.registry import load_all, oracle_text, spark_callable  # noqa: E402


SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(entry, spark, con, sf_dir: str) -> tuple[bool, str]:
    df = spark_callable(entry)(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if entry.oracle is None:
        return False, f"{len(got)} rows, but no oracle"
    cur = con.execute(oracle_text(entry.oracle))
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    index = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in index) for r in rows]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    got.sort(key=_sort_key)
    want.sort(key=_sort_key)
    for i, c in enumerate(cols):
        kinds = ({_kind(r[i]) for r in got} - {"null"}, {_kind(r[i]) for r in want} - {"null"})
        if kinds[0] != kinds[1]:
            return False, f"kind of {c}: {kinds}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, {cols}: first {bad[0]}"
    return (len(got) > 0), f"{len(got)} rows" + ("" if got else " EMPTY")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default=SMALL)
    parser.add_argument("prefix", nargs="*")
    args = parser.parse_args()
    from strandline import get_session

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    import logging

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    con = connect(args.d)
    failed = 0
    for name, entry in load_all().items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        started = time.time()
        try:
            ok, note = compare(entry, spark, con, args.d)
        except Exception as error:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(error)).strip()[:600]
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - started:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

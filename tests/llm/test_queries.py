"""Registered queries against DuckDB, learned ones against held-out labels."""

import glob
import os
import zlib

import duckdb
import pytest

from strandline.llm.queries import ORACLES, QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def normal(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert normal(found.select(columns).collect()) == normal(expected)


def auc(pairs):
    bad, good = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    return wins / len(good) / len(bad)


@pytest.mark.parametrize("name, column, least", [("op3_quality_classifier", "quality", 0.9), ("op6_toxicity", "toxic", 0.85)])
def test_held_out_labels_are_ranked(spark, name, column, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = QUERIES[name](spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) >= least

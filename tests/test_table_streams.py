"""Tables as streams: one file or a folder of files, cut into parts."""

import os

import pytest
from oracle import SMALL

from strandline.plans import stream_queries
from strandline.plans.fixtures import Tables


@pytest.fixture()
def folders(spark, tmp_path):
    """The small tables, those that the queries below stream as folders of three files."""
    for file in os.listdir(SMALL):
        if file == "conversations.parquet":
            spark.read.parquet(f"{SMALL}/{file}").repartition(3).write.parquet(str(tmp_path / file))
        else:
            os.symlink(f"{SMALL}/{file}", tmp_path / file)
    return Tables(spark, str(tmp_path))


def test_batches_of_a_table_in_a_folder(tables, folders, rows):
    got = rows(stream_queries.accept_in_order(folders))
    assert got == rows(stream_queries.accept_in_order(tables)) and len(got) == tables.conversations.count()


def test_no_batches(spark, tmp_path, rows):
    os.mkdir(tmp_path / "conversations.parquet")
    Tables(spark, SMALL).conversations.limit(0).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    assert rows(stream_queries.accept_in_order(Tables(spark, str(tmp_path)))) == []


def test_catalog_of_a_table_in_a_folder(tables, folders, rows):
    got = rows(stream_queries.apply_catalog_events(folders))
    assert got and got == rows(stream_queries.apply_catalog_events(tables))


@pytest.mark.parametrize("table, by", [("fs_journal", "txid"), ("samples", "ts_s")])
def test_parts_of_two_calls_fit_however_the_rows_are_read(spark, tmp_path, table, by):
    """The second call reads the same rows from other files, as another run may in another order of tasks."""
    events = spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/events.parquet")
    for name, files in (("first", 1), ("second", 29)):
        events.repartition(files).write.parquet(str(tmp_path / name / "events.parquet"))
    for name, only in (("first", range(2)), ("second", range(2, 4))):
        Tables(spark, str(tmp_path / name)).stream_in_parts(table, by, 4, str(tmp_path / "parts"), only)
    written = [spark.read.parquet(str(tmp_path / "parts" / f"{k:03d}")).select(by) for k in range(4)]
    assert sum(part.count() for part in written) == events.count()
    ends = [part.selectExpr(f"min({by})", f"max({by})").first() for part in written]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_parts_of_one_value_and_of_none(spark, tmp_path, tables, monkeypatch):
    for n, values in enumerate(([], [5], [7, 7, None], [None])):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        monkeypatch.setattr(Tables, "__call__", lambda self, name: df)
        tables.stream_in_parts("any", "v", 4, str(tmp_path / str(n)))
        assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / str(n))).count() == len(values)

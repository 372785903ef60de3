"""Paths of any store and file lists dealt out to tasks."""

import os

import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from strandline.sources import files, stores


def per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize(
    "given, one",
    [("file:///a/b/", "/a/b"), ("file:/a/b", "/a/b"), ("/a/b", "/a/b"), ("/", "/"), ("s3://bucket/dir/", "s3://bucket/dir"), ("hdfs://nn:8020/a", "hdfs://nn:8020/a")],
)
def test_one_spelling(spark, given, one):
    assert stores.canonical(given) == one
    assert spark.createDataFrame([(given,)], "p string").select(stores.canonical_path(F.col("p"))).first()[0] == one


@pytest.fixture()
def bucket(tmp_path, monkeypatch):
    """A store whose paths come back without scheme and host, as those of object stores do."""
    for name in ("t/a.txt", "t/sub/_b.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as out:
            out.write(name)
    local = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    real = stores.open_store
    opened = lambda path: (local, path.removeprefix("far://host/")) if path.startswith("far://") else real(path)
    monkeypatch.setattr(files, "open_store", opened)
    return "far://host/t"


def test_listing_keeps_the_scheme(bucket):
    listed = pd.concat(files._list_folders(iter([pd.DataFrame({"path": [bucket]})])))
    assert sorted(listed["path"]) == [f"{bucket}/a.txt", f"{bucket}/sub"]
    inner = pd.concat(files._list_folders(iter([listed[listed["is_dir"]]])))
    assert list(inner["path"]) == [f"{bucket}/sub/_b.txt"]
    (hashed,) = files._hash_files(iter([pa.record_batch([pa.array([*inner["path"], f"{bucket}/gone"])], ["place"])]))
    assert [d is not None for d in hashed.column(1).to_pylist()] == [True, False]


def test_many_folders_are_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(2000):
        os.makedirs(f"{tmp_path}/d{k}")
    open(f"{tmp_path}/d7/f.csv", "w").write("x")
    seen = []
    real = stores.dealt_by_number

    def watched(df, *args):
        out = real(df, *args)
        seen.append(per_task(out))
        return out

    monkeypatch.setattr(stores, "dealt_by_number", watched)
    assert [r.rel_path for r in files.list_tree(spark, str(tmp_path)).collect()] == ["d7/f.csv"]
    assert sum(seen[1]) == 2000 and len(seen[1]) == 8 and max(seen[1]) < 400
    monkeypatch.setattr(files, "FOLDERS_A_TASK", 20)
    files.list_tree(spark, str(tmp_path))
    assert len(seen[3]) > 80


def test_adaptive_execution_keeps_the_number_of_tasks(spark):
    listed = spark.range(5000).select(F.concat(F.lit("/p"), "id").alias("path"))
    out = stores.dealt_by_number(listed, "path", 5000, 100)
    assert len(per_task(out.filter("path is not null"))) == 50
    assert len(per_task(stores.dealt_by_number(listed.limit(3), "path", 3, 100))) <= 3


def test_skewed_sizes_are_packed_by_bytes(spark):
    sizes = [1 << 30] * 6 + [1 << 20] * 1000 + [0] * 500 + [None] * 3
    listed = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").withColumn("place", F.concat(F.lit("/p"), "k"))
    out = stores.dealt_by_bytes(listed, "place", "size", 128 << 20)
    tasks = out.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("bytes"), F.max("size").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(t["n"] for t in tasks) == len(sizes)
    assert all(t["bytes"] < 256 << 20 for t in tasks if t["top"] is not None and t["top"] < 1 << 30)
    assert all(t["bytes"] <= 3 << 30 for t in tasks) and len(tasks) >= 11
    # few bytes in all are spread over the tasks that run at once
    assert len(per_task(stores.dealt_by_bytes(listed.filter("size = 1048576"), "place", "size", 1 << 40))) >= 7
    assert stores.dealt_by_bytes(listed.limit(0), "place", "size").count() == 0


def test_preview_reads_whole_characters(spark, tmp_path):
    os.makedirs(f"{tmp_path}/t")
    for name, data in (("a.txt", "é€x".encode()), ("b.txt", b"\xff\xfeok"), ("_hidden", b"x"), ("c", b"")):
        with open(f"{tmp_path}/t/{name}", "wb") as out:
            out.write(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.truncated, r.length) for r in files.preview_text(spark, f"{tmp_path}/t", 4).collect()}
    assert got == {"a.txt": ("é", True, 6), "b.txt": ("��ok", False, 4), "c": ("", False, 0)}
    one = files.preview_text(spark, f"file://{tmp_path}/t/a.txt", 5).first()
    assert (one.text, one.truncated) == ("é€", True)

"""Files, catalogs, connectors and exports."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from strandline.plans.step_graph import Edge, StepGraph, sql_step, step
from strandline.sources import files, sinks
from strandline.streaming import records


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(text if isinstance(text, bytes) else text.encode())


def test_csv_preview(spark, tmp_path, rows):
    write(f"{tmp_path}/a.csv", 'id,name,role\n1, "Ann, B" ,dev\n2,Bob,ops\n')
    df = files.preview_delimited(spark, f"{tmp_path}/a.csv", max_rows=1)
    assert df.columns == ["id", "name", "role", "truncated"]
    assert rows(df) == [("1", "Ann, B", "dev", True)]
    write(f"{tmp_path}/b.tsv", "x\ty\n1\t2\n")
    assert rows(files.read_any(spark, f"{tmp_path}/b.tsv")) == [("1", "2")]


def test_read_any(spark, tmp_path, rows):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    spark.range(3).coalesce(1).write.orc(f"{tmp_path}/o.orc")
    write(f"{tmp_path}/n.md", "line\n")
    write(f"{tmp_path}/b.binary", b"\x00" * 2048)
    assert files.read_any(spark, f"{tmp_path}/p.parquet").count() == 3
    assert files.read_any(spark, f"{tmp_path}/o.orc").count() == 3
    assert rows(files.read_any(spark, f"{tmp_path}/n.md")) == [("line",)]
    assert files.read_any(spark, f"{tmp_path}/b.binary").first()["note"] == "binary file, no preview, 2.0 KB"


def test_text_preview(spark, tmp_path):
    write(f"{tmp_path}/t/a.txt", "héllo")
    got = files.preview_text(spark, f"{tmp_path}/t", 3).first()
    assert (got["text"], got["length"], got["truncated"]) == ("hé", 6, True)


def test_tree_keeps_markers_and_skips_staging(spark, tmp_path, rows):
    for name in ("t/_SUCCESS", "t/dt=1/p.parquet", "t/_delta_log/0.json", "t/_temporary/0/x", "t/.hid", "t/f.tmp", "t/.staging/y"):
        write(f"{tmp_path}/{name}", "x")
    assert rows(files.list_tree(spark, str(tmp_path)), "rel_path") == [("t/_SUCCESS",), ("t/_delta_log/0.json",), ("t/dt=1/p.parquet",)]
    assert rows(files.scan_manifest(spark, str(tmp_path)), "rel_path") == [("t/_SUCCESS",), ("t/_delta_log/0.json",), ("t/dt=1/p.parquet",)]


def test_checksums_of_every_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HASH_CHUNK", 2)
    for name in ("a b", "_c", ".d", "t/_log/0", "changed", "extra"):
        write(f"{tmp_path}/r/{name}", b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    write(f"{tmp_path}/r/changed", b"abd")
    names = ["a b", "_c", ".d", "t/_log/0", "changed", "missing"]
    declared = spark.createDataFrame([(f"{tmp_path}/r/{n}", good) for n in names], "path string, checksum string")
    found = files.verify_checksums(spark, f"{tmp_path}/r", declared).collect()
    got = {r.path.removeprefix(f"{tmp_path}/r/"): (r.actual, r.matches) for r in found}
    altered = hashlib.sha256(b"abd").hexdigest()
    assert got == {n: (good, True) for n in names[:4]} | {"changed": (altered, False), "missing": (None, False), "extra": (good, False)}


def test_checksums(spark, tmp_path, rows):
    write(f"{tmp_path}/c/a", b"abc")
    write(f"{tmp_path}/c/b", b"abc")
    listing = spark.read.format("binaryFile").load(f"{tmp_path}/c").select("path")
    good = hashlib.sha256(b"abc").hexdigest().upper()
    declared = listing.select("path", F.when(F.col("path").endswith("a"), good).otherwise("00").alias("checksum"))
    assert rows(files.verify_checksums(spark, f"{tmp_path}/c", declared), "matches") == [(False,), (True,)]


def test_catalog_columns(spark, rows):
    spark.sql("CREATE OR REPLACE TEMP VIEW cat_view AS SELECT 1 AS a, 'x' AS b")
    got = files.catalog_columns(spark, "default").filter("table_name = 'cat_view'")
    assert rows(got, "column_name", "column_type") == [("a", "int"), ("b", "string")]


def test_jdbc_options(spark):
    reader = files.jdbc_query(spark, "jdbc:x://h/db", "SELECT 1", 500, 30, user="u")
    assert reader is not None
    with pytest.raises(Exception, match="(?i)driver"):
        reader.load()


def test_topic_columns(spark, rows):
    raw = spark.createDataFrame(
        [("t", 3, 9, 5, b"k", None, [("h", b"v")])],
        "topic string, partition int, offset long, ts long, key binary, value binary, headers array<struct<key:string,value:binary>>",
    ).withColumn("timestamp", F.timestamp_millis("ts"))
    out = records.to_topic(records.from_topic(raw), "copy").first()
    assert (out["topic"], out["partition"], bytes(out["key"]), out["value"]) == ("copy", 3, b"k", None)
    assert [(h["key"], bytes(h["value"])) for h in out["headers"]] == [("h", b"v"), ("X-Source-Timestamp", b"5")]
    with pytest.raises(Exception, match="(?i)kafka"):
        records.read_topic(spark, "h:1", ["t"])


def test_csv_export(spark, tmp_path, rows):
    df = spark.createDataFrame([("=1+1", None, 'a"b'), ("-x", "ok", "t\ty")], "a string, b string, c string")
    sinks.export_csv(df.coalesce(1), f"{tmp_path}/out")
    got = sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == ['"\'-x","ok","t\ty"', '"\'=1+1","","a""b"', '"a","b","c"']


def test_compaction_writes_one_file_per_bundle(spark, tmp_path, rows):
    root = f"{tmp_path}/small"
    spark.range(40).repartition(8).write.parquet(root)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root)
    no = F.regexp_extract("path", "part-([0-9]+)", 1).cast("long")
    plan = listing.select("path", F.lit("f").alias("folder"), F.floor(no / 4).alias("bundle_no"))
    sinks.compact_small_files(spark, root, plan, f"{tmp_path}/big")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/big").select("id").collect()) == list(range(40))
    found = [f for _, _, names in os.walk(f"{tmp_path}/big") for f in names if f.endswith(".parquet")]
    assert len(found) == 2


def test_compaction_loses_no_row(spark, tmp_path):
    root = f"{tmp_path}/in"
    for k, name in enumerate(["a b", "c%20d", "e+f", "big"]):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(f"{root}/{name}")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    bundle = F.when(~F.col("path").contains("/big/"), F.lit(0).cast("long"))
    plan = listing.select("path", F.lit("f").alias("folder"), bundle.alias("bundle_no"))
    sinks.compact_small_files(spark, root, plan, f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in found.select("id").collect()) == list(range(40))
    assert found.filter("bundle_no = 0").count() == 30


def test_upsert_takes_the_newest_and_null_keys(spark, rows):
    target = spark.createDataFrame([(None, "old"), ("a", "old"), ("b", "old")], "k string, v string")
    updates = spark.createDataFrame([(None, "1", 1), ("a", "1", 1), ("a", "2", 2)], "k string, v string, n int")
    got = sinks.upsert_partitions(target, updates, ["k"], [F.desc("n")])
    assert rows(got.select("k", "v")) == sorted([("a", "2"), ("b", "old"), (None, "1")], key=lambda r: tuple((v is None, str(v)) for v in r))


def test_step_graph(spark, rows):
    base = step("base", lambda: spark.range(4))
    even = step("even", lambda base: base.filter("id % 2 = 0"))
    total = sql_step("total", "SELECT sum(id) AS s FROM {even}")
    graph = StepGraph([total, even, base], [Edge("base", "even"), Edge("even", "total")])
    assert graph.order() == ["base", "even", "total"]
    assert rows(graph.run(spark)["total"]) == [(2,)]
    with pytest.raises(ValueError, match="cycle"):
        StepGraph([base, even], [Edge("base", "even"), Edge("even", "base")]).order()
    with pytest.raises(ValueError, match="itself"):
        StepGraph([base], [Edge("base", "base")]).order()
    with pytest.raises(ValueError, match="unknown"):
        StepGraph([base], [Edge("base", "x")]).order()


def test_scratch_folder_follows_the_session(spark):
    from strandline.session import scratch_path

    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(f"{root}/x-") and first != second


def test_entry_points():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200


def test_worker_functions_need_no_package_on_the_executors():
    from pyspark import cloudpickle

    from strandline.operators import joins, packing

    assert "strandline" in cloudpickle.list_registry_pickle_by_value()
    for fn in (joins._weight, packing._next_start):
        # code by value is far longer than a reference to the module
        assert len(cloudpickle.dumps(fn)) > 400

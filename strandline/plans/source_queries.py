"""Registered queries of the scans and sinks.

Where a scan needs another format or a folder of many files, Spark writes it from
the given tables into the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.packing import plan_bundles
from strandline.plans.fixtures import GIVEN, written_files
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sources import files, sinks
from strandline.streaming.journal import read_fs_journal
from strandline.streaming.records import from_topic, to_topic
from strandline.streaming.tables import appended


@query(
    "S01_preview_total",
    "SELECT count(*) AS total, least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM lineitem",
)
def preview_total(t):
    return files.preview_summary(t.lineitem)


@query(
    "S01_preview_columnar",
    """SELECT least(count(*), 100) AS shown, least(count(*), 100) AS in_table, count(*) > 100 AS truncated,
         'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM customer""",
)
def preview_columnar(t):
    shown = files.preview_columnar(t.spark, t.path("customer"))
    columns = [c for c in shown.columns if c != "truncated"]
    # any rows will do, but they are rows of the table, each once
    met = shown.join(t.customer.withColumn("there", F.lit(1)), columns, "left")
    return met.agg(
        F.count(F.lit(1)).alias("shown"), F.count("there").alias("in_table"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
    ).withColumn("columns", F.lit(",".join(columns)))


def _described(table: str) -> str:
    kinds = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END"
    return f"SELECT 'listed_{table}' AS table_name, column_name, {kinds} AS column_type FROM (DESCRIBE {table})"


@query("S09_catalog_columns", " UNION ALL ".join(_described(table) for table in GIVEN))
def catalog_columns(t):
    for table in GIVEN:
        t(table).createOrReplaceTempView(f"listed_{table}")
    listed = files.catalog_columns(t.spark, "default")
    return listed.filter(F.col("table_name").startswith("listed_")).select("table_name", "column_name", "column_type")


@query(
    "S02_parquet_file_stats",
    """SELECT l_returnflag AS folder, count(*) AS rows, true AS one_group_each, true AS has_bytes,
         'l_orderkey:INT64,l_partkey:INT64,l_suppkey:INT64,l_linenumber:INT32,l_quantity:DOUBLE,l_extendedprice:DOUBLE,l_discount:DOUBLE,l_tax:DOUBLE,l_linestatus:BYTE_ARRAY,l_shipdate:INT64' AS columns
       FROM lineitem GROUP BY l_returnflag""",
)
def parquet_file_stats(t):
    root = scratch_path(t.spark, "stats")
    t.lineitem.write.partitionBy("l_returnflag").parquet(root)
    stats = files.parquet_file_stats(files.parquet_files(t.spark, root))
    folder = F.regexp_extract("path", "l_returnflag=([^/]+)", 1)
    return stats.groupBy(folder.alias("folder")).agg(
        F.sum("rows").alias("rows"), (F.sum("row_groups") == F.count("path")).alias("one_group_each"),
        (F.min("size") > 0).alias("has_bytes"), F.max("columns").alias("columns"),
    )


@query(
    "S03_orc_text",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done, o_orderpriority AS raw FROM orders""",
)
def orc_text(t):
    root = scratch_path(t.spark, "orc")
    t.orders.select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_orderstatus") == "F").alias("done"), F.encode("o_orderpriority", "UTF-8").alias("raw"),
    ).write.orc(root)
    return files.orc_text(t.spark.read.orc(root))


@query(
    "S04_read_delimited",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', ' || c_mktsegment AS label, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer""",
)
def read_delimited(t):
    root = scratch_path(t.spark, "csv")
    label = F.concat("c_name", F.lit(", "), "c_mktsegment")
    rows = t.customer.select("c_custkey", label.alias("label"), F.concat(F.lit("  "), F.col("c_acctbal"), F.lit(" ")).alias("c_acctbal"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    return files.read_delimited(t.spark, root)


@query(
    "S05_preview_text",
    """SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source""",
)
def preview_text(t):
    root = scratch_path(t.spark, "text")
    t.documents.select("source", "text").write.partitionBy("source").text(root)
    shown = files.preview_text(t.spark, root, 1 << 30)
    return shown.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(
        F.sum("length").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars")
    )


@query(
    "S05_preview_text_cut",
    """WITH f AS (SELECT item_id, 'x' || repeat('é', 1 + item_id % 7) || replace(text, chr(10), ' ') AS t FROM benchmark)
       SELECT item_id, CAST(octet_length(encode(t)) AS BIGINT) AS length, true AS truncated,
         substr(t, 1, list_max(list_filter(range(1, 9), lambda n: octet_length(encode(substr(t, 1, n))) <= 8))) AS text FROM f""",
)
def preview_text_cut(t):
    root = scratch_path(t.spark, "texts")
    text = F.concat(F.lit("x"), F.expr("repeat('é', CAST(1 + item_id % 7 AS INT))"), F.translate("text", "\n", " "))
    path = F.concat(F.lit(f"{root}/"), "item_id", F.lit(".txt"))
    written_files(t.benchmark.select(path.alias("path"), F.encode(text, "UTF-8").alias("content")))
    shown = files.preview_text(t.spark, root, 8)
    return shown.select(F.regexp_extract("path", "([0-9]+).txt$", 1).cast("long").alias("item_id"), "length", "truncated", "text")


@query(
    "S06_file_type",
    r"""WITH e AS (SELECT doc_id, path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS extension FROM paths)
        SELECT doc_id, path, extension, CASE WHEN extension IN ('csv', 'tsv', 'orc') THEN extension WHEN extension IN ('parquet', 'parq') THEN 'parquet'
          WHEN extension IN ('txt', 'log', 'json', 'xml', 'yaml', 'yml', 'md', 'sql', 'sh', 'py', 'java', 'properties', 'conf', 'config', 'env', 'ini', 'toml') OR length(extension) <= 4 THEN 'text' ELSE 'binary' END AS file_type FROM e""",
)
def file_type(t):
    return files.with_file_type(t.paths.select("doc_id", "path"))


@query(
    "S07_scan_manifest",
    """SELECT DISTINCT 'source=' || source || '/part' AS file, true AS has_rows FROM documents
       UNION ALL SELECT * FROM (VALUES ('_SUCCESS', false), ('_delta_log/_SUCCESS', false), ('_delta_log/part', true)) AS v (file, has_rows)""",
)
def scan_manifest(t):
    root = scratch_path(t.spark, "manifest")
    t.documents.select("source", "doc_id").write.partitionBy("source").parquet(root)
    t.documents.select(F.max("doc_id").alias("version")).write.json(f"{root}/_delta_log")
    manifest = files.scan_manifest(t.spark, root)
    return manifest.groupBy(F.regexp_replace("rel_path", "part-[^/]*$", "part").alias("file")).agg(
        ((F.sum("size") > 0) & (F.min("mtime_s") > 0)).alias("has_rows")
    )


@query(
    "S07_manifest_sizes",
    "SELECT 'd' || (page_id % 50) || '/_' || page_id || '.html' AS rel_path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages",
)
def manifest_sizes(t):
    root = scratch_path(t.spark, "pages")
    path = F.concat(F.lit(f"{root}/d"), F.col("page_id") % 50, F.lit("/_"), "page_id", F.lit(".html"))
    written_files(t.pages.select(path.alias("path"), F.encode("html", "UTF-8").alias("content")))
    return files.scan_manifest(t.spark, root).select("rel_path", "size")


@query("S07_list_tree", "SELECT DISTINCT source || '/' || lang AS folder, true AS has_files FROM documents UNION ALL SELECT '_SUCCESS' AS folder, false AS has_files")
def list_tree(t):
    root = scratch_path(t.spark, "tree")
    t.documents.select("source", "lang", "doc_id").write.partitionBy("source", "lang").parquet(root)
    tree = files.list_tree(t.spark, root)
    folder = F.regexp_replace(F.regexp_replace("rel_path", "(source|lang)=", ""), "/part-[^/]*$", "")
    return tree.groupBy(folder.alias("folder")).agg((F.sum("size") > 0).alias("has_files"))


@query(
    "S11_read_event_log",
    "SELECT event_id, event_type FROM catalog_events WHERE event_id > 500 ORDER BY event_id LIMIT 1000",
)
def read_event_log(t):
    return files.read_event_log(t.catalog_events.select("event_id", "event_type"), 500)


@query("S13_read_fs_journal", "SELECT op, path, src, dst, size, txid FROM fs_journal")
def fs_journal(t):
    root = scratch_path(t.spark, "journal")
    t.fs_journal.write.json(root)
    return appended(read_fs_journal(t.spark, root), "journal-rows")


@query(
    "S14_read_table",
    "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment",
)
def read_table(t):
    t.customer.createOrReplaceTempView("strandline_customers")
    return t.spark.table("strandline_customers").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "K01_save_table",
    "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1",
)
def save_table(t):
    path = scratch_path(t.spark, "daily_sales")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    daily = t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount")
    )
    sinks.save_table(daily, name, path=path)
    return t.spark.table(name)


_CELL = "'\"' || replace(CASE WHEN regexp_matches({0}, '^[=+@-]') THEN '''' || {0} ELSE {0} END, '\"', '\"\"') || '\"'"


@query(
    "K02_export_csv",
    f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_acctbal < 0 THEN '=SUM("' || c_name || '")' WHEN c_acctbal < 3000 THEN '' ELSE c_name || ',x' END AS label, CAST(c_acctbal AS VARCHAR) AS b FROM customer)
        SELECT {_CELL.format('k')} || ',' || {_CELL.format('label')} || ',' || {_CELL.format('b')} AS line FROM c""",
)
def export_csv(t):
    path = scratch_path(t.spark, "export-csv")
    label = (
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit('=SUM("'), "c_name", F.lit('")')))
        .when(F.col("c_acctbal") < 3000, None)
        .otherwise(F.concat("c_name", F.lit(",x")))
    )
    sinks.export_csv(t.customer.select("c_custkey", label.alias("label"), "c_acctbal"), path, header=False)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "K03_export_json",
    """SELECT '{"id":' || id || ',"status":"' || status || '","sync_mode":' || CASE WHEN sync_mode IS NULL THEN 'null' ELSE '"' || sync_mode || '"' END || '}' AS line FROM jobs""",
)
def export_json(t):
    path = scratch_path(t.spark, "export-json")
    sinks.export_json(t.jobs.select("id", "status", "sync_mode"), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "K05_overwrite_partitions",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, -1.0e0, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
)
def overwrite_partitions(t):
    path = scratch_path(t.spark, "overwrite")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.overwrite_table_atomically(rows, path, ["o_orderstatus"])
    again = rows.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    sinks.overwrite_table_atomically(again.withColumn("o_totalprice", F.lit(-1.0)), path, ["o_orderstatus"])
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "K06_upsert_by_key",
    """WITH u AS (SELECT db, table_name, part_name, 'new' AS state FROM partitions_src WHERE location LIKE '%1')
       SELECT * FROM u UNION ALL SELECT t.db, t.table_name, t.part_name, 'old' AS state FROM partitions_tgt t
       WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.db = t.db AND u.table_name = t.table_name AND u.part_name = t.part_name)""",
)
def upsert_by_key(t):
    keys = ["db", "table_name", "part_name"]
    updates = t.partitions_src.filter(F.col("location").endswith("1")).select(*keys, F.lit("new").alias("state"))
    stale = updates.withColumn("state", F.lit("stale"))
    return sinks.upsert_partitions(
        t.partitions_tgt.withColumn("state", F.lit("old")), updates.unionByName(stale), keys, [F.asc("state")]
    )


@query("K07_compact_small_files", "SELECT doc_id, n_chars, source FROM documents")
def compact_small_files(t):
    root, out = scratch_path(t.spark, "small"), scratch_path(t.spark, "compacted")
    rows = t.documents.select("doc_id", "n_chars", "source")
    rows.filter("doc_id % 5 <> 0").coalesce(1).write.parquet(f"{root}/large part%1")
    rows.filter("doc_id % 5 = 0").repartition(16).write.parquet(f"{root}/small +1")
    reader = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    listing = reader.load(root).select(
        "path", F.col("length").alias("size"), F.lit("all").alias("folder"),
        F.regexp_extract("path", "part-([0-9]+)", 1).cast("long").alias("no"),
    )
    largest = listing.agg(F.max("size")).first()[0]
    plan = plan_bundles(listing, ["folder"], "no", largest, 64 << 20, 5)
    sinks.compact_small_files(t.spark, root, plan, out)
    return t.spark.read.parquet(out).select("doc_id", "n_chars", "source")


def _raw_topic(t):
    """Records in the shape the stream source gives them."""
    from strandline.plans.filter_queries import with_headers

    return with_headers(t.records).select(
        "topic", F.col("part").alias("partition"), F.col("rec_offset").alias("offset"),
        F.timestamp_millis("ts_ms").alias("timestamp"), F.encode("rec_key", "UTF-8").alias("key"), "value", "headers",
    )


@query(
    "S10_topic_records",
    "SELECT topic, part, rec_offset, ts_ms, rec_key, payload_hex IS NULL AS is_tombstone FROM records",
)
def topic_records(t):
    return from_topic(_raw_topic(t)).select(
        "topic", "part", "rec_offset", F.unix_millis("ts").alias("ts_ms"), F.decode("key", "UTF-8").alias("rec_key"),
        F.col("value").isNull().alias("is_tombstone"),
    )


@query(
    "K04_topic_rows",
    """SELECT 'copy-' || topic AS topic, part AS "partition", rec_key AS key, payload_hex AS value_hex, concat_ws(';', 'trace=' || rec_key, 'X-Repl-Origin=' || origin, 'X-Repl-Hop=' || hop, 'X-Source-Timestamp=' || ts_ms) AS headers FROM records""",
)
def topic_rows(t):
    rows = to_topic(from_topic(_raw_topic(t)).withColumn("topic", F.concat(F.lit("copy-"), "topic")))
    shown = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))
    return rows.select(
        "topic", "partition", F.decode("key", "UTF-8").alias("key"), F.hex("value").alias("value_hex"),
        F.array_join(shown, ";").alias("headers"),
    )

"""Registered queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import display, events, names, paths, statements, wire
from strandline.operators.joins import map_schema_ids, parse_mappings, rewrite_location
from strandline.plans.filter_queries import with_headers
from strandline.plans.fixtures import NOW_S, ORDERS_NOW_S
from strandline.plans.fixtures import written_files
from strandline.plans.registry import query

MAPPINGS = "blog.tionsh.example.net=dr1.lake;m.ththth.example.net->hdfs://dr2:8020/, www.ththhe.example.com = dr3"

_PATH_OF = """CASE WHEN rtrim(b, '/') = '' THEN '/' WHEN starts_with(b, '/') THEN rtrim(b, '/') ELSE '/' || rtrim(b, '/') END"""


@query(
    "P01_normalize_path",
    """SELECT doc_id, path, trim(regexp_replace(trim(path), '^.*?://[^/]*', ''), '/') AS clean,
       CASE WHEN starts_with(regexp_replace(path, '^[^/]+?://[^/]*', ''), '/') THEN regexp_replace(path, '^[^/]+?://[^/]*', '') ELSE '/' || path END AS rooted FROM paths""",
)
def normalize_path(t):
    c = F.col("path")
    return t.paths.select("doc_id", "path", paths.normalize_path(c).alias("clean"), paths.path_of(c).alias("rooted"))


@query(
    "P02_rewrite_location",
    r"""WITH p AS (SELECT page_id, location, regexp_extract(location, '^([a-z]+)://', 1) AS s, regexp_extract(location, '^[a-z]+://([^/]*)', 1) AS a,
           regexp_extract(location, '^[a-z]+://[^/]*(.*)$', 1) AS r FROM locations)
        SELECT page_id, location, CASE a WHEN 'blog.tionsh.example.net' THEN s || '://dr1.lake' || r WHEN 'm.ththth.example.net' THEN 'hdfs://dr2:8020' || r
              WHEN 'www.ththhe.example.com' THEN s || '://dr3' || r ELSE s || '://' || regexp_replace(a, '\borg\b', 'mirror', 'g') || r END AS target_location,
           a NOT IN ('blog.tionsh.example.net', 'm.ththth.example.net', 'www.ththhe.example.com') AND NOT regexp_matches(a, '\borg\b') AS unmapped FROM p""",
)
def rewritten_location(t):
    return rewrite_location(t.locations, parse_mappings(MAPPINGS), None, "ORG", "mirror")


@query(
    "P02_rewrite_default_fs",
    r"""SELECT doc_id, CASE WHEN contains(path, '://') THEN 'hdfs://dr:9000' || regexp_replace(path, '^[a-z]+://[^/]*', '')
               WHEN starts_with(path, '/') THEN 'hdfs://dr:9000' || path ELSE 'hdfs://dr:9000/' || path END AS target_location, false AS unmapped FROM paths""",
)
def rewritten_to_default(t):
    return rewrite_location(t.paths, default_fs="hdfs://dr:9000/", column="path").select(
        "doc_id", "target_location", "unmapped"
    )


@query(
    "P04_target_path",
    f"""WITH c AS (SELECT page_id, location, regexp_replace(location, '^[^/]+?://[^/]*', '') AS b FROM locations), p AS (SELECT page_id, {_PATH_OF} AS p FROM c)
        SELECT page_id, CASE WHEN p = '/en' THEN '/mirror/x' WHEN starts_with(p, '/en/') THEN '/mirror/x' || substr(p, 4) ELSE '/mirror/x/' || regexp_extract(p, '([^/]*)$', 1) END AS target FROM p""",
)
def target_path(t):
    return t.locations.select(
        "page_id", paths.target_path(F.col("location"), F.lit("hdfs://nn/en/"), F.lit("mirror/x/")).alias("target")
    )


@query(
    "P05_within_table",
    "SELECT page_id, location, starts_with(regexp_replace(location, '/+$', ''), regexp_extract(location, '^[a-z]+://[^/]*', 0) || '/en/') AS inside FROM locations",
)
def within_table(t):
    table = F.concat(F.regexp_extract("location", "^[a-z]+://[^/]*", 0), F.lit("/en//"))
    return t.locations.select("page_id", "location", paths.within_table(F.col("location"), table).alias("inside"))


@query(
    "P06_sanitize_params",
    """SELECT table_name, CASE WHEN transactional IS NULL THEN 'owner' ELSE 'owner,transactional' END AS kept FROM source_tables""",
)
def sanitize_params(t):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    entries = F.array_compact(
        F.array(
            pair("owner", F.col("table_type")), pair("hdp.version", F.lit("3")), pair("COLUMN_STATS_ACCURATE", F.lit("x")),
            F.when(F.col("transactional").isNotNull(), pair("transactional", F.col("transactional"))),
        )
    )
    kept = F.map_keys(events.sanitize_params(F.map_from_entries(entries)))
    return t.source_tables.select("table_name", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query(
    "P07_partition_name",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_custkey || ',' || c_mktsegment || ',' || c_nationkey ELSE 'k=' || c_custkey || '/seg=' || c_mktsegment END AS part_name FROM customer""",
)
def partition_name(t):
    pair = F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment"))
    values = F.when(F.col("c_acctbal") > 5000, F.concat(pair, F.array(F.col("c_nationkey").cast("string")))).otherwise(pair)
    keys = F.array(F.lit("k"), F.lit("seg"))
    return t.customer.select("c_custkey", paths.partition_name(keys, values).alias("part_name"))


@query(
    "P08_partition_values",
    """SELECT part_name, split_part(split_part(part_name, '/', 1), '=', 2) || '|' || replace(split_part(split_part(part_name, '/', 2), '=', 2), '%20', ' ') AS "values" FROM partitions_tgt""",
)
def partition_values(t):
    return t.partitions_tgt.select(
        "part_name", F.array_join(paths.partition_values(F.col("part_name")), "|").alias("values")
    )


@query(
    "P09_codec_for",
    """SELECT doc_id, path, CASE WHEN regexp_matches(lower(path), '\\.(parquet|parq|orc|snappy|sz|gz|gzip|tgz|zst|zstd|lz4|bz2|bzip2|zip|jar|war|xz|7z|avro)$') THEN 'NONE' ELSE 'ZSTD' END AS codec FROM paths""",
)
def codec_for(t):
    return t.paths.select("doc_id", "path", paths.codec_for(F.col("path"), "ZSTD").alias("codec"))


_FORMAT = """CASE WHEN payload_hex IS NULL OR length(payload_hex) < 10 THEN 'PASSTHROUGH' WHEN payload_hex LIKE '00%' THEN 'CONFLUENT_AVRO'
             WHEN substr(payload_hex, 1, 2) IN ('02', '03') AND length(payload_hex) >= 18 THEN 'HWX_AVRO' ELSE 'PASSTHROUGH' END"""


@query("P10_classify_payload", f"SELECT topic, part, rec_offset, {_FORMAT} AS format FROM records")
def classify_payload(t):
    return t.records.select(
        "topic", "part", "rec_offset", wire.classify_payload(F.unhex("payload_hex")).alias("format")
    )


@query(
    "P11_transcode",
    f"""WITH f AS (SELECT topic, part, rec_offset, payload_hex, {_FORMAT} AS fmt FROM records),
        i AS (SELECT *, CASE fmt WHEN 'CONFLUENT_AVRO' THEN CAST('0x' || substr(payload_hex, 3, 8) AS BIGINT) WHEN 'HWX_AVRO' THEN CAST('0x' || substr(payload_hex, 3, 16) AS BIGINT) END AS sid FROM f),
        m AS (SELECT i.*, s.target_id FROM i LEFT JOIN schema_ids s ON s.topic = i.topic AND s.source_id = i.sid)
        SELECT topic, part, rec_offset,
          CASE WHEN target_id IS NULL THEN payload_hex WHEN fmt = 'CONFLUENT_AVRO' THEN '00' || lpad(hex(target_id), 8, '0') || substr(payload_hex, 11)
               ELSE '00' || lpad(hex(target_id), 8, '0') || substr(payload_hex, 19) END AS to_confluent,
          CASE WHEN target_id IS NULL THEN payload_hex WHEN fmt = 'CONFLUENT_AVRO' THEN '02' || lpad(hex(target_id), 16, '0') || substr(payload_hex, 11)
               ELSE substr(payload_hex, 1, 2) || lpad(hex(target_id), 16, '0') || substr(payload_hex, 19) END AS to_hwx FROM m""",
)
def transcode(t):
    value = F.unhex("payload_hex")
    fmt = wire.classify_payload(value)
    records = t.records.withColumn("value", value).withColumn("fmt", fmt)
    mapped = map_schema_ids(records.withColumn("source_id", wire.schema_id(F.col("value"), F.col("fmt"))), t.schema_ids)
    to = lambda target: F.hex(wire.transcode(F.col("value"), F.col("fmt"), target, F.col("target_id")))
    return mapped.select(
        "topic", "part", "rec_offset", to(wire.CONFLUENT).alias("to_confluent"), to(wire.HWX).alias("to_hwx")
    )


@query(
    "P12_enrich_headers",
    """SELECT topic, part, rec_offset, 'trace=' || rec_key || ';X-Repl-Origin=' || coalesce(origin, 'dc9') || ';X-Repl-Hop=' || (coalesce(try_cast(trim(hop) AS INT), 0) + 1) AS headers FROM records""",
)
def enrich_headers(t):
    enriched = wire.enrich_headers(F.col("headers"), "dc9")
    shown = F.transform(enriched, lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))
    return with_headers(t.records).select("topic", "part", "rec_offset", F.array_join(shown, ";").alias("headers"))


@query("P13_event_body", "SELECT doc_id, sha256(text) AS body FROM documents")
def event_body(t):
    packed = F.col("lang") == "de"
    message = F.when(packed, events.pack_body(F.col("text"))).otherwise(F.col("text"))
    fmt = F.when(packed, "gzip(json-2.0)").otherwise("json-0.2")
    return t.documents.select("doc_id", F.sha2(events.event_body(message, fmt), 256).alias("body"))


def _event_bodies(t):
    k, s = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    pair, as_map = F.array(k, s), F.struct(k.alias("k"), s.alias("seg"))
    body = (
        F.when(s == "BUILDING", F.to_json(F.struct(F.array(F.struct(pair.alias("values"))).alias("partitions"))))
        .when(s == "MACHINERY", F.to_json(F.struct(F.array(as_map, as_map).alias("partitions"))))
        .when(s == "HOUSEHOLD", F.to_json(F.struct(as_map.alias("keyValues"))))
        .when(s == "FURNITURE", F.to_json(F.struct(F.struct(pair.alias("values")).alias("partition"))))
        .otherwise(F.to_json(F.struct(F.array(pair, pair).alias("partitionValues"))))
    )
    return t.customer.select("c_custkey", "c_mktsegment", body.alias("body"))


@query(
    "P14_event_partition_values",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN c_custkey || '/' || c_mktsegment || ';' || c_custkey || '/' || c_mktsegment
              ELSE c_custkey || '/' || c_mktsegment END AS "values" FROM customer""",
)
def event_partition_values(t):
    lists = F.transform(events.event_partition_values(F.col("body")), lambda v: F.array_join(v, "/"))
    return _event_bodies(t).select("c_custkey", F.array_join(lists, ";").alias("values"))


@query(
    "P15_event_insert",
    """SELECT c_custkey, c_custkey || '/' || c_mktsegment AS "values", 'f' || c_custkey || ',g' || c_nationkey AS files, c_acctbal > 3000 AS is_replace FROM customer""",
)
def event_insert(t):
    k = F.col("c_custkey").cast("string")
    thrift = F.to_json(F.struct(F.struct(F.array(F.lit("str"), F.lit("2"), k, F.col("c_mktsegment")).alias("lst")).alias("1")))
    files = F.array(
        F.concat(F.lit("hdfs://nn/w/f"), k, F.lit("###abc")), F.concat(F.lit("g"), "c_nationkey"),
        F.concat(F.lit("hdfs://other/x/f"), k),
    )
    body = F.to_json(F.struct(thrift.alias("ptnObjJson"), files.alias("files"), (F.col("c_acctbal") > 3000).alias("replace")))
    parsed = t.customer.withColumn("i", events.event_insert(body))
    return parsed.select(
        "c_custkey", F.array_join("i.values", "/").alias("values"), F.array_join("i.files", ",").alias("files"),
        F.col("i.replace").alias("is_replace"),
    )


@query(
    "P16_event_rename",
    """SELECT event_id, table_name AS before, coalesce(renamed_to, upper(table_name)) AS after, renamed_to IS NOT NULL AS is_rename FROM catalog_events""",
)
def event_rename(t):
    table = lambda c: F.to_json(F.struct(F.struct(c.alias("str")).alias("1")))
    after = F.struct(F.struct(F.coalesce("renamed_to", F.upper("table_name")).alias("str")).alias("1"))
    body = F.to_json(
        F.struct(table(F.col("table_name")).alias("tableObjBeforeJson"), F.to_json(after).alias("tableObjAfterJson"))
    )
    return t.catalog_events.withColumn("r", events.event_rename(body)).select("event_id", "r.before", "r.after", "r.is_rename")


@query(
    "P17_bounded_label",
    """SELECT id, CASE WHEN engine IS NULL OR trim(engine) = '' THEN 'unknown' WHEN lower(trim(engine)) IN ('trino', 'hive') THEN lower(trim(engine)) ELSE 'other' END AS label FROM statements""",
)
def bounded_label(t):
    return t.statements.select("id", names.bounded_label(F.col("engine"), ["trino", "hive"]).alias("label"))


@query(
    "P18_to_display",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS VARCHAR) AS price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') AS shipped,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, '["' || l_returnflag || '","' || l_linestatus || '"]' AS flags, '{"n":' || l_linenumber || ',"p":' || l_partkey || '}' AS item FROM lineitem""",
)
def to_display(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
        F.col("l_shipdate").alias("shipped"), F.to_date("l_shipdate").alias("day"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).alias("item"),
    )
    return display.to_display(rows)


@query(
    "P19_binary_preview",
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) > 64 THEN '0x' || lower(substr(hex(encode(text)), 1, 128)) || '... (' || octet_length(encode(text)) || ' bytes)'
              ELSE '0x' || lower(hex(encode(text))) END AS preview FROM documents""",
)
def binary_preview(t):
    return t.documents.select("doc_id", display.binary_preview(F.encode("text", "UTF-8")).alias("preview"))


@query(
    "P19_text_preview",
    "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... (' || length(text) || ' characters)' ELSE text END AS preview FROM documents",
)
def text_preview(t):
    return t.documents.select("doc_id", display.text_preview(F.col("text"), 1000).alias("preview"))


@query(
    "P20_fmt_size",
    """SELECT job_id, seq, part_id, file_size, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', floor(file_size / 1024.0e0 * 10 + 0.5) / 10)
         WHEN file_size < 1073741824 THEN printf('%.1f MB', floor(file_size / 1048576.0e0 * 10 + 0.5) / 10) ELSE printf('%.2f GB', floor(file_size / 1073741824.0e0 * 100 + 0.5) / 100) END AS shown FROM tasks""",
)
def fmt_size(t):
    return t.tasks.select("job_id", "seq", "part_id", "file_size", display.fmt_size(F.col("file_size")).alias("shown"))


@query(
    "P20_fmt_memory",
    """WITH m AS (SELECT agent_id, load * 700 AS mb, load * 700 / 1048576.0e0 AS tb, load * 700 / 1024.0e0 AS gb FROM members)
       SELECT agent_id, CASE WHEN abs(mb) >= 1048576 THEN CASE WHEN tb = floor(tb) THEN printf('%.0f TB', tb) WHEN abs(abs(tb) % 0.1e0) < 0.01 THEN printf('%.1f TB', sign(tb) * floor(abs(tb) * 10 + 0.5) / 10) ELSE printf('%.2f TB', sign(tb) * floor(abs(tb) * 100 + 0.5) / 100) END
         WHEN abs(mb) >= 1024 THEN CASE WHEN gb = floor(gb) THEN printf('%.0f GB', gb) WHEN abs(abs(gb) % 0.1e0) < 0.01 THEN printf('%.1f GB', sign(gb) * floor(abs(gb) * 10 + 0.5) / 10) ELSE printf('%.2f GB', sign(gb) * floor(abs(gb) * 100 + 0.5) / 100) END
         ELSE printf('%d MB', mb) END AS memory,
         CASE WHEN load = 0 THEN '' ELSE CASE WHEN load > 0 THEN '+' ELSE '' END || CASE WHEN abs(load) >= 1024 THEN CASE WHEN load % 1024 = 0 THEN printf('%.0f GB', load / 1024.0e0) ELSE printf('%.2f GB', sign(load / 1024.0e0) * floor(abs(load / 1024.0e0) * 100 + 0.5) / 100) END ELSE printf('%d MB', load) END END AS delta FROM m JOIN members USING (agent_id)""",
)
def fmt_memory(t):
    mb = F.col("load") * 700
    return t.members.select(
        "agent_id", display.fmt_memory(mb).alias("memory"), display.fmt_delta(mb, mb + F.col("load")).alias("delta")
    )


@query(
    "P21_referenced_tables",
    r"""WITH x AS (SELECT id, regexp_extract_all(sql_text, '(?i)(?:FROM|JOIN)\s+([a-zA-Z0-9_.]+)', 1) AS n FROM statements)
        SELECT id, unnest(CASE WHEN len(n) > 0 THEN n ELSE ['unknown_table'] END) AS table_name FROM x""",
)
def referenced_tables(t):
    return t.statements.select("id", F.explode(statements.referenced_tables(F.col("sql_text"))).alias("table_name"))


@query(
    "P22_lint",
    """WITH f AS (SELECT id, CASE WHEN contains(upper(sql_text), 'SELECT *') AND NOT contains(upper(sql_text), 'LIMIT') THEN 1 ELSE 0 END AS a,
            CASE WHEN contains(upper(sql_text), 'JOIN') AND NOT contains(upper(sql_text), ' ON ') AND NOT contains(upper(sql_text), ' USING ') THEN 1 ELSE 0 END AS b FROM statements)
       SELECT id, concat_ws(',', CASE WHEN a = 1 THEN 'avoid-select-star-without-limit' END, CASE WHEN b = 1 THEN 'join-missing-on' END) AS flags,
         CASE WHEN a + b = 0 THEN 1 ELSE (a + b) * 2 + 1 END AS score, CASE WHEN a + b = 0 THEN 'low' ELSE 'medium' END AS level, b = 0 AS valid FROM f""",
)
def lint(t):
    flags = statements.lint_flags(F.col("sql_text"))
    score = statements.lint_score(flags)
    return t.statements.select(
        "id", F.array_join(flags, ",").alias("flags"), score.alias("score"), statements.lint_level(score).alias("level"),
        (~F.array_contains(flags, statements.JOIN_RULE)).alias("valid"),
    )


@query(
    "P23_query_operations",
    """WITH o AS (SELECT id, concat_ws(',', CASE WHEN contains(upper(sql_text), 'JOIN') THEN 'JOIN' END, CASE WHEN contains(upper(sql_text), 'GROUP BY') THEN 'GROUP BY' END,
          CASE WHEN contains(upper(sql_text), 'ORDER BY') THEN 'ORDER BY' END, CASE WHEN contains(upper(sql_text), 'WHERE') THEN 'WHERE' END) AS ops FROM statements)
       SELECT id, CASE WHEN ops = '' THEN 'SCAN' ELSE ops END AS ops FROM o""",
)
def query_operations(t):
    return t.statements.select("id", F.array_join(statements.query_operations(F.col("sql_text")), ",").alias("ops"))


@query(
    "P24_verify_checksums",
    """SELECT d.doc_id, l.quality IS NULL OR l.quality = 1 AS matches FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def verify_checksums(t):
    from strandline.session import scratch_path
    from strandline.sources.files import verify_checksums

    root = scratch_path(t.spark, "checked-files")
    path = F.concat(F.lit(f"{root}/"), F.when(F.col("doc_id") % 2 == 1, F.lit("_")).otherwise(F.lit("")), F.col("doc_id").cast("string"))
    good = F.coalesce(F.col("quality"), F.lit(1)) == 1
    found = t.documents.join(t.labels, "doc_id", "left").select(
        path.alias("path"), F.upper(F.sha2("text", 256)).alias("checksum"),
        F.when(good, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("content"),
    )
    written_files(found.select("path", F.encode("content", "UTF-8").alias("content")))
    verdicts = verify_checksums(t.spark, root, found.select("path", "checksum"))
    return verdicts.select(F.regexp_extract("path", "_?([0-9]+)$", 1).cast("long").alias("doc_id"), "matches")


@query(
    "P25_issues",
    """SELECT id, concat_ws('; ', status, sync_mode, job_type) AS joined, CASE WHEN length(concat_ws('; ', status, sync_mode, job_type)) > 20 THEN substr(concat_ws('; ', status, sync_mode, job_type), 1, 17) || '...'
         ELSE concat_ws('; ', status, sync_mode, job_type) END AS cut, 1 + CASE WHEN sync_mode IS NULL THEN 0 ELSE 1 END + CASE WHEN job_type IS NULL THEN 0 ELSE 1 END AS n FROM jobs""",
)
def issues(t):
    listed = F.array_compact(F.array("status", "sync_mode", "job_type"))
    joined = display.join_issues(listed)
    return t.jobs.select(
        "id", joined.alias("joined"), display.join_issues(listed, 20).alias("cut"),
        F.size(display.split_issues(joined)).alias("n"),
    )


@query(
    "P26_progress",
    f"""SELECT id, CASE WHEN total_bytes > 0 THEN least(100.0e0, round(CAST(copied_bytes AS DOUBLE) / total_bytes * 10000) / 100) ELSE 0.0e0 END AS percent,
         coalesce(CASE WHEN copied_bytes > 0 THEN round(copied_bytes / 1048576.0e0 / greatest({ORDERS_NOW_S} - started_s, 1) * 100) / 100 END, -1.0e0) AS mb_s FROM jobs""",
)
def progress(t):
    return t.jobs.select(
        "id", display.progress_percent(F.col("copied_bytes"), F.col("total_bytes")).alias("percent"),
        F.coalesce(display.speed_mb_s(F.col("copied_bytes"), F.lit(ORDERS_NOW_S) - F.col("started_s")), F.lit(-1.0)).alias("mb_s"),
    )


@query(
    "P27_lag_ms",
    f"SELECT rec_offset, greatest(0, {NOW_S - 86400 * 3}000 - ts_ms) AS lag FROM records",
)
def lag_ms(t):
    return t.records.select("rec_offset", display.lag_ms(F.lit((NOW_S - 86400 * 3) * 1000), F.col("ts_ms")).alias("lag"))


@query(
    "P28_norm_type",
    """SELECT table_name, column_name, regexp_replace(lower(column_type), '\\s+', '', 'g') AS t FROM source_columns""",
)
def norm_type(t):
    return t.source_columns.select("table_name", "column_name", names.norm_type(F.col("column_type")).alias("t"))


@query(
    "P29_monotonic",
    "SELECT id, greatest(coalesce(CASE WHEN status = 'PAUSED' THEN NULL ELSE lag_ms END, 0), messages) AS kept FROM topic_jobs",
)
def monotonic(t):
    current = F.when(F.col("status") != "PAUSED", F.col("lag_ms"))
    return t.topic_jobs.select("id", display.monotonic(current, F.col("messages")).alias("kept"))

"""Registered queries of the projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import names, paths, wire
from strandline.operators import filters
from strandline.operators.joins import validate_changes
from strandline.plans.registry import query
from strandline.plans.templates import top_customers


@query(
    "F01_norm_id",
    """SELECT id, lower(replace(replace(source_cluster, '-', ''), '_', '')) AS src,
              lower(replace(replace(target_cluster, '-', ''), '_', '')) AS tgt FROM jobs
       WHERE lower(replace(replace(source_cluster, '-', ''), '_', '')) = lower(replace(replace(target_cluster, '-', ''), '_', ''))""",
)
def norm_id(t):
    src, tgt = names.norm_id(F.col("source_cluster")), names.norm_id(F.col("target_cluster"))
    return t.jobs.filter(src == tgt).select("id", src.alias("src"), tgt.alias("tgt"))


@query(
    "F02_local_part",
    """SELECT id, lower(CASE WHEN strpos(created_by, '@') > 0 THEN substr(created_by, 1, strpos(created_by, '@') - 1)
                             ELSE created_by END) AS who FROM jobs WHERE created_by IS NOT NULL""",
)
def local_part(t):
    return t.jobs.filter(F.col("created_by").isNotNull()).select("id", names.local_part(F.col("created_by")).alias("who"))


@query(
    "F03_search_any",
    """SELECT id, source_path FROM jobs WHERE lower(coalesce(source_path, '')) LIKE '%set1%'
       OR lower(coalesce(created_by, '')) LIKE '%set1%' OR lower(coalesce(principal, '')) LIKE '%user1%'
       OR lower(coalesce(source_path, '')) LIKE '%user1%' OR lower(coalesce(created_by, '')) LIKE '%user1%'""",
)
def search_any(t):
    cols = ["source_path", "created_by", "principal"]
    either = filters.any_contains(cols, "SET1") | filters.any_contains(cols, "user1")
    return t.jobs.filter(either).select("id", "source_path")


@query(
    "F03_search_like",
    "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%the_th%' OR lower(source) LIKE '%the_th%'",
)
def search_like(t):
    return filters.search_any(t.documents, ["text", "source"], "the_th", like=True).select("doc_id", "source")


@query(
    "F04_search_row",
    """SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS STRING) LIKE '%42%' OR lower(c_name) LIKE '%42%'
       OR CAST(c_nationkey AS STRING) LIKE '%42%' OR lower(c_mktsegment) LIKE '%42%'""",
)
def search_row(t):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return filters.search_row(rows, "42").select("c_custkey", "c_name")


@query(
    "F05_visible_to",
    """SELECT id FROM jobs WHERE created_by IS NULL OR trim(created_by) = '' OR lower(split_part(created_by, '@', 1)) IN ('system', 'user7')
       OR lower(split_part(principal, '@', 1)) = 'user7'""",
)
def visible_to(t):
    return t.jobs.filter(names.visible_to(F.col("created_by"), F.col("principal"), "user7")).select("id")


@query(
    "F06_visible_saved",
    "SELECT id, username, created_s FROM statements WHERE username = 'u7' OR shared",
)
def visible_saved(t):
    return filters.visible_saved(t.statements, "u7", "created_s").select("id", "username", "created_s")


@query(
    "F07_status_filter",
    "SELECT id, status FROM jobs WHERE status IN ('STREAMING', 'streaming') OR upper(sync_mode) = 'STREAMING_INOTIFY'",
)
def status_filter(t):
    return filters.status_filter(t.jobs, "STREAMING").select("id", "status")


@query(
    "F08_exclude_types",
    "SELECT id, job_type FROM jobs WHERE job_type IS NULL OR upper(job_type) NOT IN ('PARTITION_COPY', 'TABLE_COPY')",
)
def exclude_types(t):
    return t.jobs.filter(names.not_of_type(F.col("job_type"), ["PARTITION_COPY", "TABLE_COPY"])).select("id", "job_type")


_CLEAN_PATH = "trim(regexp_replace(trim(replace(path, '\\', '/')), '^.*?://[^/]*', ''), '/')"


@query(
    "F09_ignored_path",
    f"""WITH c AS (SELECT doc_id, path, {_CLEAN_PATH} AS clean FROM paths),
        s AS (SELECT doc_id, path, clean, regexp_split_to_array(clean, '/+') AS segs FROM c),
        x AS (SELECT doc_id, path, list_transform(segs[1:len(segs) - 1], lambda d: lower(trim(d))) AS dirs, lower(trim(segs[len(segs)])) AS leaf FROM s)
        SELECT doc_id, path,
          len(list_filter(dirs, lambda d: d <> '_delta_log' AND d <> '' AND (d LIKE '.%' OR starts_with(d, '_') OR starts_with(d, '-ext-')
              OR regexp_matches(d, '(hive|spark|tez)[-_]staging') OR d = 'lost+found' OR regexp_matches(d, '\\.(tmp|temp|staging)$')))) > 0
          OR (leaf NOT IN ('', '_success', '_success.crc', '_metadata', '_common_metadata') AND (leaf LIKE '.%'
              OR leaf IN ('thumbs.db', 'desktop.ini') OR regexp_matches(leaf, '(hive|spark)[-_]staging')
              OR regexp_matches(leaf, '\\.(tmp|temp|inprogress|staging|pending|copying|part|partial|swp|swo)$') OR leaf LIKE '%~'
              OR contains(leaf, '_copying_') OR starts_with(leaf, '_temporary') OR starts_with(leaf, '_tmp')
              OR regexp_matches(leaf, '\\._staging_[a-z0-9_-]+$'))) AS ignored
        FROM x""",
)
def ignored_path(t):
    return t.paths.select("doc_id", "path", paths.is_ignored_path(F.col("path")).alias("ignored"))


@query(
    "F10_staged_path",
    """SELECT doc_id, path, regexp_matches(path, '/_temporary|/\\.hive-staging|/\\.spark-staging|/\\.staging|/\\.tmp|/\\.Trash')
              OR regexp_matches(path, '\\.(tmp|crc|inprogress)$') AS staged FROM paths""",
)
def staged_path(t):
    return t.paths.select("doc_id", "path", paths.is_staged_path(F.col("path")).alias("staged"))


_PATH_OF = """CASE WHEN rtrim(b, '/') = '' THEN '/' WHEN starts_with(b, '/') THEN rtrim(b, '/') ELSE '/' || rtrim(b, '/') END"""


@query(
    "F11_under_path",
    f"""WITH c AS (SELECT page_id, location, regexp_replace(location, '^[^/]+?://[^/]*', '') AS b FROM locations),
        p AS (SELECT page_id, location, {_PATH_OF} AS p FROM c)
        SELECT page_id, location FROM p WHERE p = '/en' OR starts_with(p, '/en/')""",
)
def under_path(t):
    return t.locations.filter(paths.under_path(F.col("location"), F.lit("/en/")))


@query(
    "F12_depth_under",
    f"""WITH c AS (SELECT page_id, regexp_replace(location, '^[^/]+?://[^/]*', '') AS b FROM locations),
        p AS (SELECT page_id, {_PATH_OF} AS p FROM c)
        SELECT page_id, CAST(CASE WHEN p = '/en' OR starts_with(p, '/en/')
            THEN len(list_filter(string_split(substr(p, 4), '/'), lambda x: x <> '')) ELSE -1 END AS INT) AS depth FROM p""",
)
def depth_under(t):
    return t.locations.select("page_id", paths.depth_under(F.col("location"), F.lit("hdfs://nn/en")).alias("depth"))


@query(
    "F13_match_names",
    "SELECT DISTINCT agent_id FROM members WHERE regexp_full_match(agent_id, 'Supplier#0+[1-9]+') AND NOT regexp_full_match(agent_id, '.*5')",
)
def match_names(t):
    keep = names.match_names(F.col("agent_id"), "Supplier#0+[1-9]+", ".*5")
    return t.members.filter(keep).select("agent_id").distinct()


@query(
    "F14_match_table",
    """SELECT table_name, table_type FROM source_tables WHERE regexp_full_match(lower(table_name), 't1*0|t1.*0|[a-z]+1.*2')""",
)
def match_table(t):
    known = names.match_table(F.col("table_name"), "T1*0") | names.match_table(F.col("table_name"), r"\p{Alpha}+1.*2")
    return t.source_tables.filter(known).select("table_name", "table_type")


_EXCLUDED = "group_id IS NULL OR trim(group_id) = '' OR regexp_full_match(trim(group_id), '(connect-.*|schema-registry-.*|console-consumer-.*|kafka-exporter-.*|__.*)')"


@query(
    "F15_allowed_groups",
    f"SELECT trim(group_id) AS group_id, topic, part FROM groups WHERE NOT ({_EXCLUDED})",
)
def allowed_groups(t):
    return filters.allowed_groups(t.groups).select("group_id", "topic", "part")


@query("F15_excluded_groups", f"SELECT DISTINCT trim(group_id) AS group_id FROM groups WHERE {_EXCLUDED}")
def excluded_groups(t):
    return filters.excluded_groups(t.groups)


@query(
    "F16_table_support",
    """SELECT table_name, coalesce(lower(transactional) <> 'true', true) AS supported,
              CASE WHEN lower(transactional) = 'true' THEN 'ACID tables are not supported (transactional=true)' ELSE 'OK' END AS reason
       FROM source_tables""",
)
def table_support(t):
    params = F.map_from_arrays(F.array(F.lit("transactional")), F.array("transactional"))
    return filters.evaluate_table(t.source_tables.withColumn("parameters", params)).select(
        "table_name", "supported", "reason"
    )


def with_headers(records):
    """Records with their headers as an array, like the stream source gives them."""
    header = lambda key, c: F.when(
        F.col(c).isNotNull(), F.struct(F.lit(key).alias("key"), F.encode(F.col(c), "UTF-8").alias("value"))
    )
    headers = F.array_compact(
        F.array(
            F.struct(F.lit("trace").alias("key"), F.encode(F.col("rec_key"), "UTF-8").alias("value")),
            header(wire.HEADER_ORIGIN, "origin"),
            header(wire.HEADER_HOP, "hop"),
        )
    )
    return records.select("*", F.unhex("payload_hex").alias("value"), headers.alias("headers"))


@query(
    "F17_should_replicate",
    """SELECT topic, part, rec_offset FROM records WHERE NOT coalesce(lower(trim(origin)) IN ('dc1', 'dc2'), false)
       AND coalesce(try_cast(trim(hop) AS INT), 0) < 3""",
)
def should_replicate(t):
    keep = wire.should_replicate(F.col("headers"), "dc1", "dc2")
    return with_headers(t.records).filter(keep).select("topic", "part", "rec_offset")


@query(
    "F18_included_events",
    """SELECT event_id, table_name, event_type FROM catalog_events
       WHERE regexp_full_match(lower(table_name), 't[0-9]*5') OR
         (upper(event_type) = 'ALTER_TABLE' AND renamed_to IS NOT NULL AND regexp_full_match(lower(renamed_to), 't[0-9]*5'))
         OR (upper(event_type) = 'ALTER_TABLE' AND renamed_to IS NOT NULL AND regexp_full_match(lower(table_name), 't[0-9]*5'))""",
)
def included_events(t):
    events = t.catalog_events.withColumn("db_name", F.lit("Lake"))
    return filters.included_events(events, "lake", "t[0-9]*5").select("event_id", "table_name", "event_type")


@query(
    "F19_event_support",
    """SELECT event_id, event_type, CASE WHEN upper(event_type) IN ('ADD_PARTITION', 'ALTER_PARTITION', 'CREATE_TABLE', 'ALTER_TABLE',
          'DROP_TABLE', 'DROP_PARTITION', 'INSERT') THEN 'HANDLED' ELSE 'SKIPPED_UNSUPPORTED' END AS support FROM catalog_events""",
)
def event_support(t):
    return filters.tag_event_support(t.catalog_events).select("event_id", "event_type", "support")


@query(
    "F20_delete_allowed",
    """SELECT e.txid, j.job_id, CASE WHEN NOT j.sync_deletes THEN false WHEN NOT j.companion THEN true
             WHEN len(string_split(substr(e.path, length('/wh/db' || j.job_id || '.db') + 2), '/')) = 1 THEN j.delete_table_dirs
             ELSE j.delete_inside_tables END AS allowed
       FROM fs_journal e JOIN stream_jobs j ON split_part(e.path, '/', 3) = 'db' || j.job_id || '.db' WHERE e.op = 'UNLINK'""",
)
def delete_allowed(t):
    jobs = t.stream_jobs.withColumn("root", paths.path_of(F.col("source_path")))
    clean = t.fs_journal.filter(F.col("op") == "UNLINK").withColumn("path", paths.path_of(F.col("path")))
    events = clean.withColumn("above", F.explode(paths.ancestors(F.col("path"))))
    allowed = paths.delete_allowed(
        F.col("path"), F.col("root"), F.col("sync_deletes"), F.col("companion"),
        F.col("delete_table_dirs"), F.col("delete_inside_tables"),
    )
    return events.join(jobs, events["above"] == jobs["root"]).select("txid", "job_id", allowed.alias("allowed"))


@query(
    "F21_top_customers",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
)
def top_balances(t):
    return top_customers(t.customer, 5000.0, 50)


@query(
    "F22_validate_capacity",
    """SELECT path, label, 'CAPACITY_RANGE' AS error FROM draft_queues WHERE action <> 'delete' AND (capacity < 0 OR capacity > 100)
       UNION ALL SELECT path, label, 'MAX_RANGE' AS error FROM draft_queues WHERE action <> 'delete' AND (max_capacity < 0 OR max_capacity > 100)
       UNION ALL SELECT path, label, 'MAX_BELOW_CAPACITY' AS error FROM draft_queues WHERE action <> 'delete' AND max_capacity + 1e-9 < capacity""",
)
def validate_capacity(t):
    return filters.validate_capacity(t.draft_queues).select("path", "label", "error")


@query(
    "F23_validate_changes",
    """SELECT d.path, d.label, CASE WHEN d.action NOT IN ('create', 'modify', 'delete') THEN 'UNKNOWN_ACTION'
          WHEN d.parent_path <> regexp_replace(d.path, '\\.[^.]*$', '') THEN 'WRONG_PARENT'
          WHEN NOT ends_with(d.path, '.' || d.name) THEN 'WRONG_NAME'
          WHEN d.action = 'create' AND l.path IS NOT NULL THEN 'ALREADY_EXISTS'
          WHEN d.action <> 'create' AND l.path IS NULL THEN 'NOT_FOUND' END AS error
       FROM draft_queues d LEFT JOIN (SELECT DISTINCT path FROM live_queues) l ON d.path = l.path
       WHERE d.action NOT IN ('create', 'modify', 'delete') OR d.parent_path <> regexp_replace(d.path, '\\.[^.]*$', '')
          OR NOT ends_with(d.path, '.' || d.name) OR (d.action = 'create') = (l.path IS NOT NULL)""",
)
def validate_change_set(t):
    return validate_changes(t.draft_queues, t.live_queues)


@query(
    "F24_elasticity",
    """SELECT path, label, max_capacity > capacity AS elastic, CASE WHEN capacity > 0 THEN round(max_capacity / capacity, 2) ELSE 1.0e0 END AS elasticity FROM live_queues""",
)
def elasticity(t):
    return filters.with_elasticity(t.live_queues).select("path", "label", "elastic", "elasticity")


@query(
    "F25_up_to_date",
    """SELECT s.rel_path, coalesce(t.rel_path IS NOT NULL AND s.size > 0 AND s.size = t.size
              AND (s.mtime_s <= 0 OR t.mtime_s <= 0 OR t.mtime_s >= s.mtime_s), false) AS fresh
       FROM source_files s LEFT JOIN target_files t ON s.rel_path = t.rel_path""",
)
def up_to_date(t):
    target = t.target_files.select("rel_path", F.col("size").alias("ts"), F.col("mtime_s").alias("tm"), F.lit(True).alias("e"))
    fresh = paths.is_up_to_date(F.coalesce("e", F.lit(False)), F.col("size"), F.col("mtime_s"), F.col("ts"), F.col("tm"))
    return t.source_files.join(target, "rel_path", "left").select("rel_path", fresh.alias("fresh"))


@query(
    "F26_valid_transition",
    """SELECT id, CASE WHEN p IS NULL THEN false WHEN p = status THEN true
          WHEN p = 'RUNNING' THEN status IN ('COMPLETED', 'FAILED') WHEN p = 'FAILED' THEN status = 'RUNNING' ELSE false END AS valid, status
       FROM (SELECT j.id, j.status, CASE j.job_type WHEN 'ROOT' THEN 'RUNNING' WHEN 'Table_Copy' THEN 'FAILED' ELSE 'COMPLETED' END AS p FROM jobs j) x""",
)
def valid_transition(t):
    before = (
        F.when(F.col("job_type") == "ROOT", "RUNNING").when(F.col("job_type") == "Table_Copy", "FAILED").otherwise("COMPLETED")
    )
    allowed = {"RUNNING": ["COMPLETED", "FAILED"], "FAILED": ["RUNNING"], "COMPLETED": []}
    return t.jobs.select("id", filters.valid_transition(before, F.col("status"), allowed).alias("valid"), "status")


@query(
    "F27_validate_policy",
    """SELECT path, lower(policy) AS policy, 'POLICY_NOT_ALLOWED' AS error FROM draft_queues d WHERE d.action <> 'delete' AND
          CASE WHEN EXISTS (SELECT 1 FROM draft_queues c WHERE c.parent_path = d.path) THEN lower(policy) NOT IN ('utilization', 'priority-utilization')
               ELSE lower(policy) NOT IN ('fifo', 'fair') END""",
)
def validate_policy(t):
    return filters.validate_policy(t.draft_queues).select("path", "policy", "error")


@query(
    "F28_filter_members",
    """SELECT agent_id, coalesce(cluster_id, '-') AS cluster FROM members WHERE lower(status) = 'online'
       AND (contains(lower(agent_id), '1') OR contains(lower(address), '1'))""",
)
def filter_members(t):
    return filters.filter_members(t.members, None, "online", "1").select(
        "agent_id", F.coalesce("cluster_id", F.lit("-")).alias("cluster")
    )



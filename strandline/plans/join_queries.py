"""Registered queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import joins, progress, sets
from strandline.plans.fixtures import ORDERS_NOW_S
from strandline.plans.registry import query
from strandline.plans.templates import top_spenders

POOL = ["recv-a:9095", "recv-b:9095", "recv-c:9095", "recv-d:9095", "recv-e:9095"]


@query(
    "J01_manifest_diff",
    """SELECT s.rel_path, s.size, CASE WHEN t.rel_path IS NOT NULL AND s.size > 0 AND s.size = t.size
              AND (s.mtime_s <= 0 OR t.mtime_s <= 0 OR t.mtime_s >= s.mtime_s) THEN 'SKIPPED' ELSE 'QUEUED' END AS action
       FROM source_files s LEFT JOIN target_files t ON s.rel_path = t.rel_path""",
)
def manifest_diff(t):
    return joins.manifest_diff(t.source_files, t.target_files)


@query(
    "J02_extraneous_tables",
    """SELECT table_name, table_type FROM target_tables t WHERE regexp_full_match(lower(table_name), 's.*')
       AND NOT EXISTS (SELECT 1 FROM source_tables s WHERE s.table_name = t.table_name)""",
)
def extraneous_tables(t):
    from strandline.functions.names import match_table

    keep = match_table(F.col("table_name"), "s*")
    return joins.extraneous(t.target_tables, t.source_tables, ["table_name"], keep).select("table_name", "table_type")


@query(
    "J03_extraneous_partitions",
    """SELECT db, table_name, part_name FROM partitions_tgt t WHERE NOT EXISTS
       (SELECT 1 FROM partitions_src s WHERE s.db = t.db AND s.table_name = t.table_name
          AND s.part_name = replace(t.part_name, '%20', ' '))""",
)
def extraneous_partitions(t):
    return joins.extraneous_partitions(t.partitions_tgt, t.partitions_src).select("db", "table_name", "part_name")


_DRIFT = """WITH b AS (SELECT s.table_name AS sn, t.table_name AS tn, s.table_type AS st, t.table_type AS tt, s.partition_keys AS sp, t.partition_keys AS tp,
            s.serde AS ss, t.serde AS ts, s.input_format AS si, t.input_format AS ti, s.output_format AS so, t.output_format AS "to"
          FROM source_tables s FULL JOIN target_tables t ON s.table_name = t.table_name),
        d AS (SELECT coalesce(sn, tn) AS table_name, CASE WHEN sn IS NULL THEN 'EXTRA_TABLE' ELSE 'MISSING_TABLE' END AS issue, '' AS detail FROM b WHERE sn IS NULL OR tn IS NULL
          UNION ALL SELECT sn, 'TABLE_TYPE', st || ' -> ' || tt FROM b WHERE sn IS NOT NULL AND tn IS NOT NULL AND st <> tt
          UNION ALL SELECT sn, 'PARTITION_KEYS', sp || ' -> ' || tp FROM b WHERE sn IS NOT NULL AND tn IS NOT NULL AND sp <> tp
          UNION ALL SELECT sn, 'SERDE', ss || ' -> ' || ts FROM b WHERE lower(ss) <> lower(ts)
          UNION ALL SELECT sn, 'INPUT_FORMAT', si || ' -> ' || ti FROM b WHERE lower(si) <> lower(ti)
          UNION ALL SELECT sn, 'OUTPUT_FORMAT', so || ' -> ' || "to" FROM b WHERE lower(so) <> lower("to"))"""


@query("J04_table_drift", _DRIFT + " SELECT table_name, issue, detail FROM d")
def table_drift(t):
    none = t.source_columns.limit(0)
    return joins.schema_drift(none, none, t.source_tables, t.target_tables)


_COLUMN_DRIFT = """SELECT coalesce(s.table_name, t.table_name) AS table_name,
          CASE WHEN t.table_name IS NULL THEN 'MISSING_COLUMN' WHEN s.table_name IS NULL THEN 'EXTRA_COLUMN' ELSE 'COLUMN_TYPE' END AS issue,
          coalesce(s.column_name, t.column_name) || ': ' || concat_ws(' -> ', s.column_type, t.column_type) AS detail
        FROM source_columns s FULL JOIN target_columns t ON s.table_name = t.table_name AND lower(s.column_name) = lower(t.column_name)
        WHERE s.table_name IS NULL OR t.table_name IS NULL OR
          regexp_replace(lower(s.column_type), '\\s+', '', 'g') <> regexp_replace(lower(t.column_type), '\\s+', '', 'g')"""


@query("J04_column_drift", _COLUMN_DRIFT)
def column_drift(t):
    return joins.column_drift(t.source_columns, t.target_columns)


@query(
    "J04_drift_report",
    f"""WITH c AS ({_COLUMN_DRIFT}),
        m AS (SELECT table_name, count(*) AS issues, string_agg(issue || ' ' || detail, '; ' ORDER BY issue || ' ' || detail COLLATE C) AS f FROM c GROUP BY table_name)
        SELECT table_name, issues, CASE WHEN length(f) > 300 THEN substr(f, 1, 297) || '...' ELSE f END AS message FROM m""".replace(
        " COLLATE C", ""
    ),
)
def drift_report(t):
    return joins.drift_report(joins.column_drift(t.source_columns, t.target_columns), 300)


@query(
    "J05_config_diff",
    """WITH dp AS (SELECT path, min(action) AS action, min(state) AS state, min(policy) AS policy, min(node_labels) AS nl FROM draft_queues GROUP BY path),
        lp AS (SELECT path, min(state) AS state, min(policy) AS policy, min(node_labels) AS nl FROM live_queues GROUP BY path),
        p AS (SELECT dp.path, lower(dp.action) = 'delete' AS del, lp.path IS NOT NULL AS known,
                dp.state IS DISTINCT FROM lp.state OR coalesce(lower(dp.policy) <> lower(lp.policy), false)
                OR coalesce(list_sort(string_split(dp.nl, ',')) <> list_sort(string_split(lp.nl, ',')), false) AS props
              FROM dp LEFT JOIN lp ON dp.path = lp.path),
        c AS (SELECT coalesce(d.path, l.path) AS path, coalesce(d.label, l.label) AS label, d.capacity AS dc, d.max_capacity AS dm, l.capacity AS lc, l.max_capacity AS lm,
                (d.path IS NULL) <> (l.path IS NULL) OR coalesce(abs(d.capacity - l.capacity) > 0.01 OR abs(d.max_capacity - l.max_capacity) > 0.01, false) AS changed
              FROM draft_queues d FULL JOIN (SELECT * FROM live_queues WHERE path IN (SELECT path FROM dp)) l ON d.path = l.path AND d.label = l.label),
        f AS (SELECT p.path, del, known, props, a.any_changed FROM p JOIN (SELECT path, bool_or(changed) AS any_changed FROM c GROUP BY path) a ON p.path = a.path)
        SELECT c.path, c.label, CASE WHEN f.known THEN 'modified' ELSE 'created' END AS action, lc AS live_capacity, dc AS draft_capacity,
               round(dc - lc, 2) AS delta_capacity, round(dm - lm, 2) AS delta_max_capacity
        FROM c JOIN f ON c.path = f.path WHERE NOT del AND ((NOT known) OR (any_changed AND changed))
        UNION ALL
        SELECT f.path, 'STANDARD', CASE WHEN del THEN 'deleted' WHEN props THEN 'modified' ELSE 'unchanged' END, lc, dc, round(dc - lc, 2), round(dm - lm, 2)
        FROM f LEFT JOIN c ON c.path = f.path AND c.label = 'STANDARD' WHERE del OR (known AND NOT any_changed)""",
)
def config_diff(t):
    return joins.config_diff(t.draft_queues, t.live_queues, "STANDARD")


_NORM = "lower(replace(replace({0}, '-', ''), '_', ''))"


@query(
    "J06_mirror_routes",
    f"""WITH k AS (SELECT id, {_NORM.format('source_cluster')} AS s, {_NORM.format('target_cluster')} AS t, source_path, target_path FROM jobs),
        m AS (SELECT a.id, min(b.id) AS mirror_id FROM k a JOIN k b ON a.s = b.t AND a.t = b.s AND a.source_path = b.target_path AND a.target_path = b.source_path
              AND a.id <> b.id GROUP BY a.id)
        SELECT k.id, m.mirror_id, m.mirror_id IS NOT NULL AS has_mirror FROM k LEFT JOIN m ON k.id = m.id""",
)
def mirror_routes(t):
    return joins.mirror_routes(t.jobs)


_LEGS = """legs AS (SELECT id, status, string_split(topics, ',') AS topics,
             CASE WHEN direction = 'BIDIRECTIONAL' THEN list_distinct([lower(source_dc) || '->' || lower(target_dc), lower(target_dc) || '->' || lower(source_dc)])
                  ELSE [lower(source_dc) || '->' || lower(target_dc)] END AS legs FROM topic_jobs)"""


@query(
    "J07_find_overlaps",
    f"""WITH {_LEGS}, c AS (SELECT id, status, leg, unnest(topics) AS topic FROM (SELECT id, status, topics, unnest(legs) AS leg FROM legs) x),
        o AS (SELECT a.id, min(b.id) AS other_id FROM c a JOIN c b ON a.leg = b.leg AND a.topic = b.topic AND a.id <> b.id AND upper(b.status) = 'ACTIVE' GROUP BY a.id)
        SELECT o.id, o.other_id, array_to_string(list_sort(list_intersect(m.topics, n.topics)), ',') AS shared_topics
        FROM o JOIN legs m ON o.id = m.id JOIN legs n ON o.other_id = n.id""",
)
def find_overlaps(t):
    jobs = t.topic_jobs.withColumn("topics", F.split("topics", ","))
    return joins.find_overlaps(jobs, active_only=True).select(
        "id", "other_id", F.array_join("shared_topics", ",").alias("shared_topics")
    )


@query(
    "J08_jobs_without_runs",
    "SELECT id, name FROM parents p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.job_id = p.id AND r.status = 'COMPLETED')",
)
def jobs_without_runs(t):
    done = t.runs.filter(F.col("status") == "COMPLETED").select(F.col("job_id").alias("id"))
    return joins.without(t.parents, done, ["id"]).select("id", "name")


@query(
    "J09_claimable_tasks",
    """SELECT job_id, seq, part_id, updated_s FROM tasks WHERE status = 'QUEUED' AND job_id IN
       (SELECT id FROM jobs j WHERE status IN ('RUNNING', 'STREAMING') AND lower(source_cluster) = 'cluster-1'
          AND NOT EXISTS (SELECT 1 FROM parents h WHERE h.id = j.parent_id AND h.status IN ('PAUSED', 'STOPPED')))""",
)
def claimable_tasks(t):
    return joins.claimable_tasks(t.tasks, t.jobs, t.parents, "CLUSTER-1").select("job_id", "seq", "part_id", "updated_s")


@query(
    "J10_ready_to_finalize",
    """WITH n AS (SELECT job_id, sum(file_count) AS total, sum(CASE WHEN status <> 'QUEUED' THEN file_count ELSE 0 END) AS done FROM tasks GROUP BY job_id)
       SELECT j.id FROM jobs j JOIN n ON j.id = n.job_id WHERE j.status = 'RUNNING' AND (j.sync_mode IS NULL OR j.sync_mode <> 'STREAMING_INOTIFY')
       AND n.total > 0 AND n.done >= n.total AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status IN ('QUEUED', 'RUNNING'))""",
)
def ready_to_finalize(t):
    amount = lambda *s: F.sum(F.when(F.col("status").isin(*s), F.col("file_count")).otherwise(0))
    counts = t.tasks.groupBy(F.col("job_id").alias("id")).agg(
        F.sum("file_count").alias("total_objects"), amount("COMPLETED").alias("transferred"), amount("SKIPPED").alias("skipped")
    )
    jobs = t.jobs.join(counts, "id").withColumn("failed", F.lit(0))
    return joins.ready_to_finalize(jobs, t.tasks).select("id")


@query(
    "J11_pending_for_cluster",
    """SELECT count(*) AS pending FROM tasks WHERE status = 'QUEUED' AND job_id IN
       (SELECT id FROM jobs WHERE lower(source_cluster) = 'cluster-2' OR lower(target_cluster) = 'cluster-2')""",
)
def pending_for_cluster(t):
    return joins.pending_for_cluster(t.tasks, t.jobs, "Cluster-2").agg(F.count(F.lit(1)).alias("pending"))


@query(
    "J12_with_run_counts",
    """SELECT j.id, count(t.job_id) AS tasks FROM jobs j LEFT JOIN tasks t ON j.id = t.job_id GROUP BY j.id""",
)
def with_run_counts(t):
    tasks = t.tasks.withColumnRenamed("job_id", "id")
    return joins.with_counts(t.jobs.select("id"), tasks, "id", "tasks")


@query(
    "J13_with_progress",
    f"""WITH a AS (SELECT parent_id, count(*) AS n, CAST(sum(total_bytes) AS BIGINT) AS t, CAST(sum(copied_bytes) AS BIGINT) AS c,
            count(*) FILTER (WHERE status = 'RUNNING') AS active, min(started_s) AS s, max(completed_s) AS e FROM jobs GROUP BY parent_id),
        x AS (SELECT p.id, n, c, t, active, e, CASE WHEN t > 0 THEN least(100.0e0, round(CAST(c AS DOUBLE) / t * 10000) / 100) ELSE 0.0e0 END AS pct,
            greatest(1, CASE WHEN active = 0 AND e IS NOT NULL THEN e ELSE {ORDERS_NOW_S} END - s) AS el FROM parents p LEFT JOIN a ON p.id = a.parent_id),
        y AS (SELECT *, CASE WHEN c > 0 THEN round(c / 1048576.0e0 / el * 100) / 100 END AS speed FROM x)
        SELECT id, coalesce(n, 0) AS jobs, coalesce(pct, 0.0e0) AS progress, coalesce(speed, -1.0e0) AS mb_s,
            CASE WHEN active = 0 AND e IS NOT NULL AND pct >= 100 THEN e
                 WHEN speed > 0 AND t > c THEN {ORDERS_NOW_S} + CAST(ceil((t - c) / (speed * 1048576.0e0)) AS BIGINT) END AS eta_s FROM y""",
)
def with_progress(t):
    return progress.with_progress(t.parents, t.jobs, ORDERS_NOW_S).select(
        "id", "jobs", "progress", F.coalesce("mb_s", F.lit(-1.0)).alias("mb_s"), "eta_s"
    )


_REQUESTS = """q AS (SELECT 'topic-' || event_type AS topic, CAST(user_id % 8 AS INT) AS part, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) + 1800000 AS ts_ms,
                 event_id AS request_id FROM events WHERE value > 50)"""


@query(
    "J14_offsets_for_times",
    f"""WITH {_REQUESTS} SELECT q.topic, q.part, q.ts_ms, q.request_id, min(r.rec_offset) AS target_offset
       FROM q LEFT JOIN records r ON r.topic = q.topic AND r.part = q.part AND r.ts_ms >= q.ts_ms GROUP BY ALL""",
)
def offsets_for_times(t):
    requests = _requests(t)
    return joins.offsets_for_times(requests, t.records)


def _requests(t):
    from strandline.functions.clock import epoch_us

    return t.events.filter(F.col("value") > 50).select(
        F.concat(F.lit("topic-"), "event_type").alias("topic"),
        (F.col("user_id") % 8).cast("int").alias("part"),
        (F.floor(epoch_us(F.col("ts")) / 1000) + 1_800_000).cast("long").alias("ts_ms"),
        F.col("event_id").alias("request_id"),
    )


_LAST = """l AS (SELECT topic, part, arg_max(ts_ms, rec_offset) AS last_ms, max(rec_offset) AS end_offset FROM records GROUP BY topic, part)"""


@query(
    "J15_translate_offsets",
    f"""WITH {_LAST}, e AS (SELECT topic, part, rec_offset, ts_ms FROM records WHERE size > 60)
        SELECT g.group_id, g.topic, g.part, g.committed, CASE WHEN e.ts_ms > 0 THEN e.ts_ms WHEN g.committed >= l.end_offset THEN l.last_ms ELSE 0 END AS ts_ms
        FROM groups g LEFT JOIN e ON e.topic = g.topic AND e.part = g.part AND e.rec_offset = g.committed
        LEFT JOIN l ON l.topic = g.topic AND l.part = g.part""",
)
def translate_offsets(t):
    exact = t.records.filter(F.col("size") > 60).select("topic", "part", "rec_offset", "ts_ms")
    return joins.translate_offsets(t.groups, exact, last_positions(t.records))


def last_positions(records):
    """Last time and offset of every stream partition."""
    return records.groupBy("topic", "part").agg(
        F.max_by("ts_ms", "rec_offset").alias("ts_ms"), F.max("rec_offset").alias("end_offset")
    )


@query(
    "J16_apply_offsets",
    """WITH c AS (SELECT group_id, topic, part, committed FROM groups WHERE topic <> 'topic-view'),
        p AS (SELECT group_id, topic, part, CASE WHEN committed % 3 = 0 THEN committed - 5 ELSE committed + 5 END AS target_offset FROM groups),
        l AS (SELECT DISTINCT group_id, CASE WHEN length(group_id) % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS liveness FROM groups)
        SELECT p.group_id, p.topic, p.part, p.target_offset FROM p LEFT JOIN c ON c.group_id = p.group_id AND c.topic = p.topic AND c.part = p.part
        JOIN l ON l.group_id = p.group_id WHERE l.liveness = 'INACTIVE' AND p.target_offset >= 0 AND (c.committed IS NULL OR p.target_offset >= c.committed)""",
)
def apply_offsets(t):
    groups = t.groups
    current = groups.filter(F.col("topic") != "topic-view")
    step = F.when(F.col("committed") % 3 == 0, F.col("committed") - 5).otherwise(F.col("committed") + 5)
    live = groups.select(
        "group_id", F.when(F.length("group_id") % 2 == 0, "ACTIVE").otherwise("INACTIVE").alias("liveness")
    ).distinct()
    return joins.apply_offsets(current, groups.withColumn("target_offset", step), live)


@query(
    "J17_map_schema_ids",
    """WITH r AS (SELECT topic, part, rec_offset, CASE WHEN substr(payload_hex, 1, 2) = '00' THEN CAST('0x' || substr(payload_hex, 3, 8) AS BIGINT)
              WHEN substr(payload_hex, 1, 2) = '02' AND length(payload_hex) >= 18 THEN CAST('0x' || substr(payload_hex, 3, 16) AS BIGINT) END AS source_id FROM records)
        SELECT r.topic, r.part, r.rec_offset, r.source_id, m.target_id, r.source_id IS NOT NULL AND m.target_id IS NULL AS id_missing
        FROM r LEFT JOIN schema_ids m ON m.topic = r.topic AND m.source_id = r.source_id""",
)
def map_schema_ids(t):
    from strandline.functions import wire

    value = F.unhex("payload_hex")
    records = t.records.withColumn("source_id", wire.schema_id(value, wire.classify_payload(value)))
    return joins.map_schema_ids(records, t.schema_ids).select(
        "topic", "part", "rec_offset", "source_id", "target_id", "id_missing"
    )


_POOL_SQL = "['" + "', '".join(POOL) + "']"


@query(
    "J18_route_partitions",
    f"""WITH p AS (SELECT DISTINCT topic, part FROM records),
        r(topic, route) AS (VALUES ('topic-view', ['recv-b:9095', 'recv-d:9095']), ('topic-click', ['other:1']), ('topic-error', [])),
        u AS (SELECT p.topic, p.part, CASE WHEN r.route IS NULL OR len(r.route) = 0 THEN {_POOL_SQL} ELSE list_filter({_POOL_SQL}, lambda e: list_contains(r.route, e)) END AS usable
              FROM p LEFT JOIN r ON p.topic = r.topic)
        SELECT topic, part, CASE WHEN len(usable) = 0 THEN 'NO_TARGET' ELSE usable[part % len(usable) + 1] END AS endpoint FROM u""",
)
def route_partitions(t):
    routes = t.records.select("topic").distinct().withColumn(
        "endpoints",
        F.when(F.col("topic") == "topic-view", F.array(F.lit("recv-b:9095"), F.lit("recv-d:9095")))
        .when(F.col("topic") == "topic-click", F.array(F.lit("other:1")))
        .when(F.col("topic") == "topic-error", F.array().cast("array<string>")),
    )
    return joins.route_partitions(t.records.select("topic", "part").distinct(), routes, POOL)


def _hrw_sql() -> str:
    """64-bit wrap-around in 128-bit integers: the same weights, from the published mixing constants."""
    two64, two63 = 2**64, 2**63
    rows = ", ".join(f"({i}, '{e}', {(joins._text_hash(e) * joins.SPREAD) % two64}::UHUGEINT)" for i, e in enumerate(POOL))

    def mix(inner: str) -> str:
        return f"CAST(xor({inner}, {inner} >> 33) AS UHUGEINT)"

    return f"""WITH e(i, endpoint, h) AS (VALUES {rows}), p AS (SELECT DISTINCT CAST(user_id AS INT) AS part FROM events),
      a AS (SELECT part, i, endpoint, xor(CAST(part AS UBIGINT) << 32, CAST(h AS UBIGINT)) AS x FROM p CROSS JOIN e),
      b AS (SELECT part, i, endpoint, CAST(CAST(xor(x, x >> 33) AS UHUGEINT) % 4294967296 * {joins.MIX_1}::UHUGEINT AS UHUGEINT) AS lo,
                   CAST((CAST(xor(x, x >> 33) AS UHUGEINT) // 4294967296) * ({joins.MIX_1}::UHUGEINT % 4294967296) % 4294967296 * 4294967296 AS UHUGEINT) AS hi FROM a),
      c AS (SELECT part, i, endpoint, CAST((lo + hi) % {two64}::UHUGEINT AS UBIGINT) AS x FROM b),
      d AS (SELECT part, i, endpoint, CAST(CAST(xor(x, x >> 33) AS UHUGEINT) % 4294967296 * {joins.MIX_2}::UHUGEINT AS UHUGEINT) AS lo,
                   CAST((CAST(xor(x, x >> 33) AS UHUGEINT) // 4294967296) * ({joins.MIX_2}::UHUGEINT % 4294967296) % 4294967296 * 4294967296 AS UHUGEINT) AS hi FROM c),
      f AS (SELECT part, i, endpoint, CAST((lo + hi) % {two64}::UHUGEINT AS UBIGINT) AS x FROM d),
      w AS (SELECT part, i, endpoint, xor(x, x >> 33) AS x FROM f),
      s AS (SELECT part, i, endpoint, CASE WHEN x >= {two63}::UBIGINT THEN CAST(x AS HUGEINT) - {two64}::HUGEINT ELSE CAST(x AS HUGEINT) END AS weight FROM w)
      SELECT part, arg_max(endpoint, weight) AS endpoint FROM s GROUP BY part"""


@query("J19_hrw_assign", _hrw_sql())
def hrw_assign(t):
    return joins.hrw_assign(t.events.select(F.col("user_id").cast("int").alias("part")).distinct(), POOL)


@query(
    "J20_site_status",
    """WITH a AS (SELECT lower(replace(replace(cluster_id, '-', ''), '_', '')) AS k, count(*) AS n, count(*) FILTER (WHERE lower(status) = 'online') AS o FROM members GROUP BY 1)
       SELECT s.site_id, coalesce(a.o, 0) AS online, coalesce(a.n, 0) AS total, CASE WHEN a.o > 0 AND a.o < a.n THEN 'DEGRADED' WHEN a.o > 0 THEN 'ONLINE' WHEN a.n > 0 THEN 'OFFLINE' ELSE 'UNKNOWN' END AS status
       FROM sites s LEFT JOIN a ON lower(s.site_id) = a.k""",
)
def site_status(t):
    return joins.site_status(t.sites, t.members)


@query(
    "J21_cluster_status",
    """SELECT s.site_id, count(*) FILTER (WHERE j.status IN ('RUNNING', 'STREAMING')) AS active, count(*) FILTER (WHERE j.status IN ('QUEUED', 'ANALYZING')) AS queued,
              count(*) FILTER (WHERE j.status = 'FAILED') AS failed, count(*) FILTER (WHERE j.status = 'COMPLETED') AS completed
       FROM sites s LEFT JOIN jobs j ON lower(replace(replace(j.source_cluster, '-', ''), '_', '')) = s.site_id GROUP BY s.site_id""",
)
def cluster_status(t):
    return joins.cluster_status(t.sites, t.jobs)


@query(
    "J22_stale_files",
    """WITH f AS (SELECT source AS folder, CASE WHEN n_chars > 3000 THEN 'sub/' || doc_id ELSE 'f' || doc_id END AS name, lang FROM documents),
        e AS (SELECT d.source AS folder, 'f' || d.doc_id AS name FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1)
        SELECT folder, name FROM f WHERE NOT contains(name, '/') AND folder IN (SELECT folder FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE e.folder = f.folder AND e.name = f.name)""",
)
def stale_files(t):
    docs = t.documents.select("doc_id", "source", "n_chars")
    name = F.when(F.col("n_chars") > 3000, F.concat(F.lit("sub/"), "doc_id")).otherwise(F.concat(F.lit("f"), "doc_id"))
    files = docs.select(F.col("source").alias("folder"), name.alias("name"))
    listed = docs.join(t.labels.filter(F.col("quality") == 1), "doc_id").select(
        F.col("source").alias("folder"), F.concat(F.lit("f"), "doc_id").alias("name")
    )
    return joins.stale_files(files, listed)


@query(
    "J23_topic_conflicts",
    """WITH s AS (SELECT 'p' || p_partkey AS topic, CASE WHEN p_type = 'PROMO' THEN 'compact, delete' ELSE 'delete' END AS pol, p_size * 1000 AS mx FROM part),
        g AS (SELECT 'p' || p_partkey AS topic, CASE WHEN p_type = 'PROMO' THEN 'delete,compact' WHEN p_type = 'LARGE' THEN 'compact' ELSE 'delete' END AS pol,
              CASE WHEN p_name LIKE 'red%' THEN p_size * 900 ELSE p_size * 1000 END AS mx FROM part)
        SELECT s.topic, 'cleanup.policy' AS conflict FROM s JOIN g ON s.topic = g.topic WHERE list_sort(list_transform(string_split(s.pol, ','), lambda x: trim(x))) <> list_sort(list_transform(string_split(g.pol, ','), lambda x: trim(x)))
        UNION ALL SELECT s.topic, 'max.message.bytes' FROM s JOIN g ON s.topic = g.topic WHERE g.mx < s.mx""",
)
def topic_conflicts(t):
    promo, large = F.col("p_type") == "PROMO", F.col("p_type") == "LARGE"
    topic = F.concat(F.lit("p"), "p_partkey").alias("topic")
    source = t.part.select(
        topic, F.when(promo, "compact, delete").otherwise("delete").alias("cleanup_policy"),
        (F.col("p_size") * 1000).alias("max_message_bytes"),
    )
    target = t.part.select(
        topic, F.when(promo, "delete,compact").when(large, "compact").otherwise("delete").alias("cleanup_policy"),
        F.when(F.col("p_name").startswith("red"), F.col("p_size") * 900).otherwise(F.col("p_size") * 1000).alias("max_message_bytes"),
    )
    return joins.topic_conflicts(source, target)


@query(
    "J24_remove_subtrees",
    """WITH d AS (SELECT 'root.Brand#' || n_nationkey AS path FROM nation WHERE n_regionkey = 1
                  UNION ALL SELECT path FROM live_queues WHERE label = 'PROMO')
       SELECT path, label FROM live_queues l WHERE NOT EXISTS (SELECT 1 FROM d WHERE l.path = d.path OR starts_with(l.path, d.path || '.'))""",
)
def remove_subtrees(t):
    roots = t.nation.filter(F.col("n_regionkey") == 1).select(F.concat(F.lit("root.Brand#"), "n_nationkey").alias("path"))
    deleted = roots.union(t.live_queues.filter(F.col("label") == "PROMO").select("path"))
    return joins.remove_subtrees(t.live_queues, deleted).select("path", "label")


@query(
    "J25_merge_config",
    """WITH del AS (SELECT DISTINCT path FROM draft_queues WHERE action = 'delete'),
        k AS (SELECT path, label, capacity FROM live_queues l WHERE NOT EXISTS (SELECT 1 FROM del WHERE l.path = del.path OR starts_with(l.path, del.path || '.'))),
        u AS (SELECT path, label, capacity FROM draft_queues WHERE action <> 'delete')
        SELECT coalesce(k.path, u.path) AS path, coalesce(k.label, u.label) AS label, coalesce(u.capacity, k.capacity) AS capacity
        FROM k FULL JOIN u ON k.path = u.path AND k.label = u.label""",
)
def merge_config(t):
    return joins.merge_config(t.live_queues, t.draft_queues)


@query(
    "J26_top_spenders",
    """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total_spent, count(*) AS orders
       FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY total_spent DESC, c_custkey LIMIT 100""",
)
def spenders(t):
    return top_spenders(t.customer, t.orders)


@query(
    "J27_reusable",
    """WITH q AS (SELECT DISTINCT parent_id, source_path, target_path FROM jobs),
        e AS (SELECT parent_id, source_path, target_path, min(id) AS existing_id FROM jobs WHERE status = 'COMPLETED' GROUP BY ALL)
        SELECT q.parent_id, q.source_path, q.target_path, e.existing_id FROM q LEFT JOIN e ON q.parent_id = e.parent_id AND q.source_path = e.source_path AND q.target_path = e.target_path""",
)
def reusable(t):
    keys = ["parent_id", "source_path", "target_path"]
    return joins.reusable(t.jobs.select(*keys).distinct(), t.jobs.filter(F.col("status") == "COMPLETED"), keys)


@query(
    "J28_barrier",
    """SELECT j.id, NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status NOT IN ('COMPLETED', 'SKIPPED')) AS ready FROM jobs j""",
)
def barrier(t):
    return joins.barrier(t.jobs.select("id"), t.tasks.withColumnRenamed("job_id", "id"))


@query(
    "J29_reconcile_deletes",
    """WITH src AS (SELECT DISTINCT '/' || rel_path AS path FROM source_files), tgt AS (SELECT DISTINCT '/' || rel_path AS path FROM target_files),
        d AS (SELECT '/src' || n_nationkey AS path FROM nation UNION ALL SELECT '/extra' UNION ALL SELECT '/' || rel_path FROM target_files WHERE size > 2000),
        g AS (SELECT path FROM d WHERE path NOT IN (SELECT path FROM src))
        SELECT path FROM tgt WHERE EXISTS (SELECT 1 FROM g WHERE tgt.path = g.path OR starts_with(tgt.path, g.path || '/')) AND path NOT IN (SELECT path FROM src)""",
)
def reconcile_deletes(t):
    rooted = F.concat(F.lit("/"), "rel_path").alias("path")
    folders = t.nation.select(F.concat(F.lit("/src"), "n_nationkey").alias("path"))
    top = F.concat(F.lit("/"), F.substring_index("rel_path", "/", 1)).alias("path")
    extra = t.target_files.filter(F.col("rel_path").startswith("extra/")).select(top).distinct()
    big = t.target_files.filter(F.col("size") > 2000).select(rooted)
    deletes = folders.union(extra).union(big)
    return joins.reconcile_deletes(deletes, t.source_files.select(rooted), t.target_files.select(rooted))


@query(
    "J30_partition_data_status",
    """WITH m AS (SELECT '/wh/' || c_nationkey || '/' || c_custkey AS folder, CASE WHEN o_orderstatus = 'P' THEN '.f' ELSE 'f' END || o_orderkey AS name,
              CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '1-URGENT')
        SELECT p.db, p.table_name, p.part_name, count(m.folder) > 0 AS "exists", count(*) FILTER (WHERE m.name NOT LIKE '.%') AS files,
               CAST(coalesce(sum(CASE WHEN m.name NOT LIKE '.%' THEN m.size ELSE 0 END), 0) AS BIGINT) AS bytes
        FROM partitions_src p LEFT JOIN m ON p.location = m.folder GROUP BY ALL""",
)
def partition_data_status(t):
    orders = t.orders.filter(F.col("o_orderpriority") != "1-URGENT").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.when(F.col("o_orderstatus") == "P", ".f").otherwise("f"), "o_orderkey")
    path = F.concat(F.lit("/wh/"), "c_nationkey", F.lit("/"), "c_custkey", F.lit("/"), name)
    manifest = orders.select(path.alias("path"), F.floor("o_totalprice").cast("long").alias("size"))
    return joins.partition_data_status(t.partitions_src, manifest).select(
        "db", "table_name", "part_name", "exists", "files", "bytes"
    )


@query(
    "U01_legs",
    f"WITH {_LEGS} SELECT id, unnest(legs) AS leg FROM legs",
)
def legs(t):
    return t.topic_jobs.select(
        "id", F.explode(joins.legs(F.col("source_dc"), F.col("target_dc"), F.col("direction"))).alias("leg")
    )


@query(
    "U02_shared",
    """SELECT id, array_to_string(list_sort(list_intersect(string_split(topics, ','), ['t' || (id % 50), 'u' || (id % 50), 'x' || id])), ',') AS shared FROM topic_jobs""",
)
def shared(t):
    wanted = F.array(
        F.concat(F.lit("t"), F.col("id") % 50), F.concat(F.lit("u"), F.col("id") % 50), F.concat(F.lit("x"), "id")
    )
    both = F.array_sort(F.array_intersect(F.split("topics", ","), wanted))
    return t.topic_jobs.select("id", F.array_join(both, ",").alias("shared"))


@query(
    "U03_all_labels",
    """SELECT path, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
       (SELECT path, label FROM draft_queues UNION ALL SELECT path, label FROM live_queues) GROUP BY path""",
)
def all_labels(t):
    to_map = lambda df, name: df.groupBy("path").agg(
        F.map_from_entries(F.collect_set(F.struct("label", F.lit(1)))).alias(name)
    )
    both = to_map(t.draft_queues, "d").join(to_map(t.live_queues, "l"), "path", "full")
    return both.select("path", F.array_join(sets.all_labels(F.col("d"), F.col("l")), ",").alias("labels"))


@query(
    "U04_set_diff",
    """SELECT rel_path, 'source' AS side FROM source_files WHERE rel_path NOT IN (SELECT rel_path FROM target_files)
       UNION ALL SELECT rel_path, 'target' AS side FROM target_files WHERE rel_path NOT IN (SELECT rel_path FROM source_files)""",
)
def set_diff(t):
    return sets.set_diff(t.source_files, t.target_files, ["rel_path"])


@query(
    "U05_logs_equal",
    """WITH a AS (SELECT topic, part, count(*) AS n FROM records GROUP BY ALL), b AS (SELECT topic, part, count(*) AS n FROM records WHERE size < 100 OR part < 5 GROUP BY ALL)
       SELECT a.topic, a.part, a.n AS source_n, coalesce(b.n, 0) AS target_n, a.n = coalesce(b.n, 0) AS equal FROM a LEFT JOIN b ON a.topic = b.topic AND a.part = b.part""",
)
def logs_equal(t):
    target = t.records.filter((F.col("size") < 100) | (F.col("part") < 5))
    return sets.logs_equal(t.records, target, ["topic", "part"])



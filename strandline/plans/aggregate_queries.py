"""Registered queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.names import bounded_label
from strandline.operators import aggregates as agg
from strandline.plans.fixtures import NOW_S, ORDERS_NOW_S
from strandline.plans.registry import query
from strandline.plans.templates import user_activity
from strandline.session import block_of


@query(
    "A01_aggregate_subjobs",
    """SELECT parent_id, count(*) AS jobs, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(copied_bytes) AS BIGINT) AS copied_bytes,
       count(*) FILTER (WHERE upper(status) IN ('RUNNING', 'QUEUED')) AS active, min(started_s) AS first_started_s, max(completed_s) AS last_completed_s
       FROM jobs GROUP BY parent_id""",
)
def aggregate_subjobs(t):
    return agg.aggregate_subjobs(t.jobs)


@query(
    "A02_root_job_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('RUNNING', 'STREAMING')) AS active, count(*) FILTER (WHERE status IN ('STOPPED', 'CANCELLED')) AS frozen,
       count(*) FILTER (WHERE status = 'FAILED') AS failed, CAST(sum(greatest(total_bytes - copied_bytes, 0)) AS BIGINT) AS remaining_bytes FROM jobs WHERE job_type IS NOT NULL""",
)
def root_job_stats(t):
    return agg.root_job_stats(t.jobs.filter(F.col("job_type").isNotNull()))


@query(
    "A03_bytes_by_status",
    "SELECT lower(status) AS status, CAST(sum(CASE WHEN lower(status) = 'completed' THEN total_bytes ELSE copied_bytes END) AS BIGINT) AS bytes FROM jobs GROUP BY 1",
)
def bytes_by_status(t):
    return agg.bytes_by_status(t.jobs)


@query(
    "A04_size_histogram",
    """WITH b(le, v) AS (VALUES ('1048576', 1048576), ('10485760', 10485760), ('104857600', 104857600), ('1073741824', 1073741824), ('10737418240', 10737418240), ('+Inf', 9000000000000000)),
       n AS (SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM tasks), c AS (SELECT b.le, count(*) AS n FROM b JOIN tasks ON file_size <= v GROUP BY b.le)
       SELECT n.files, n.bytes, b.le, coalesce(c.n, 0) AS n FROM b CROSS JOIN n LEFT JOIN c ON b.le = c.le""",
)
def size_histogram(t):
    return agg.size_histogram(t.tasks)


@query(
    "A05_pool_summary",
    """SELECT job_id, count(*) AS tasks, CAST(sum(file_count) AS BIGINT) AS objects, CAST(sum(file_size) AS BIGINT) AS bytes,
       CAST(sum(CASE WHEN status = 'SKIPPED' THEN file_count ELSE 0 END) AS BIGINT) AS skipped_objects, CAST(sum(CASE WHEN status = 'SKIPPED' THEN file_size ELSE 0 END) AS BIGINT) AS skipped_bytes
       FROM tasks GROUP BY job_id""",
)
def pool_summary(t):
    return agg.pool_summary(t.tasks)


@query(
    "A06_replication_totals",
    """SELECT count(*) AS rows, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(copied_bytes), 0) AS BIGINT) AS copied_bytes FROM jobs
       UNION ALL SELECT count(*) AS rows, CAST(coalesce(sum(total_bytes), 0) AS BIGINT), CAST(coalesce(sum(copied_bytes), 0) AS BIGINT) FROM jobs WHERE status = 'NONE'""",
)
def replication_totals(t):
    cols = ["total_bytes", "copied_bytes"]
    return agg.replication_totals(t.jobs, cols).union(agg.replication_totals(t.jobs, cols, F.col("status") == "NONE"))


@query(
    "A07_topic_totals",
    """SELECT count(*) AS jobs, count(*) FILTER (WHERE upper(status) = 'ACTIVE') AS active, count(*) FILTER (WHERE upper(status) = 'PAUSED') AS paused,
       CAST(sum(messages) AS BIGINT) AS messages, max(lag_ms) AS max_lag_ms FROM topic_jobs""",
)
def topic_totals(t):
    return agg.topic_totals(t.topic_jobs)


@query(
    "A08_active_sessions",
    """SELECT 'c' || (id % 3) AS cluster, CASE WHEN engine IS NULL OR trim(engine) = '' THEN 'unknown' WHEN lower(trim(engine)) IN ('trino', 'hive') THEN lower(trim(engine)) ELSE 'other' END AS kind,
       count(*) AS sessions FROM statements WHERE status NOT IN ('KILLED', 'FAILED') GROUP BY 1, 2""",
)
def active_sessions(t):
    cluster = F.concat(F.lit("c"), F.col("id") % 3)
    return agg.active_sessions(t.statements, cluster, bounded_label(F.col("engine"), ["trino", "hive"]), ["KILLED", "FAILED"])


@query(
    "A09_status_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed
       FROM jobs WHERE source_cluster = 'Cluster-1'""",
)
def status_summary(t):
    return agg.status_summary(t.jobs, ["RUNNING", "COMPLETED", "FAILED"], F.col("source_cluster") == "Cluster-1")


@query(
    "A10_authors",
    "SELECT DISTINCT created_by FROM jobs WHERE trim(created_by) <> '' ORDER BY created_by LIMIT 500",
)
def authors(t):
    return agg.authors(t.jobs, "created_by")


@query(
    "A11_directory_totals",
    """SELECT source, count(*) FILTER (WHERE n_chars >= 200) AS files, count(*) FILTER (WHERE n_chars < 200) AS folders,
       CAST(coalesce(sum(CASE WHEN n_chars >= 200 THEN n_chars END), 0) AS BIGINT) AS bytes FROM documents GROUP BY source""",
)
def directory_totals(t):
    kind = F.when(F.col("n_chars") < 200, "DIRECTORY").otherwise("FILE")
    entries = t.documents.select("source", kind.alias("kind"), F.col("n_chars").alias("size"))
    return agg.directory_totals(entries, ["source"])


@query(
    "A12_branch_balance",
    """WITH s AS (SELECT parent_path, label, round(sum(capacity), 2) AS capacity FROM live_queues GROUP BY ALL)
       SELECT parent_path, label, capacity, round(100.0e0 - capacity, 2) AS unallocated,
         CASE WHEN abs(round(100.0e0 - capacity, 2)) < 0.01 OR (label <> 'STANDARD' AND abs(capacity) < 0.01) THEN 'ok' WHEN capacity > 100 THEN 'overallocated' ELSE 'underallocated' END AS status FROM s""",
)
def branch_balance(t):
    return agg.branch_balance(t.live_queues, "STANDARD")


@query("A13_max_or_zero", "SELECT job_id, coalesce(max(run_number), 0) AS max_run_number FROM runs GROUP BY job_id")
def max_or_zero(t):
    return agg.max_or_zero(t.runs, ["job_id"], "run_number")


@query(
    "A14_duration_histogram",
    """WITH b(le, v) AS (VALUES ('0.1', 0.1e0), ('0.5', 0.5e0), ('1.0', 1.0e0), ('5.0', 5.0e0), ('10.0', 10.0e0), ('30.0', 30.0e0), ('60.0', 60.0e0), ('300.0', 300.0e0), ('+Inf', 1e18)),
        s AS (SELECT 'c' || (id % 3) AS cluster, status, duration_ms / 1000.0e0 AS d FROM statements)
        SELECT s.cluster, s.status, b.le, count(*) FILTER (WHERE s.d <= b.v) AS n FROM s CROSS JOIN b GROUP BY ALL""",
)
def duration_histogram(t):
    rows = t.statements.withColumn("cluster", F.concat(F.lit("c"), F.col("id") % 3))
    return agg.cumulative_histogram(rows, F.col("duration_ms") / 1000.0, agg.DURATION_BOUNDS_S, ["cluster", "status"])


@query(
    "A15_bootstrap_speed",
    f"""WITH a AS (SELECT parent_id, sum(copied_bytes) AS c, min(started_s) AS s FROM jobs GROUP BY parent_id)
        SELECT round(sum(CAST(c AS DOUBLE) / greatest(1, {ORDERS_NOW_S} - s)), 3) AS bytes_s FROM a WHERE c > 0""",
)
def bootstrap_speed(t):
    return agg.bootstrap_speed(t.jobs, ORDERS_NOW_S)


@query(
    "A16_weighted_latency",
    """WITH b(le, v) AS (VALUES ('0.001', 0.001e0), ('0.005', 0.005e0), ('0.01', 0.01e0), ('0.025', 0.025e0), ('0.05', 0.05e0), ('0.1', 0.1e0), ('0.25', 0.25e0), ('0.5', 0.5e0), ('1.0', 1e0), ('2.0', 2e0), ('5.0', 5e0), ('+Inf', 1e18)),
        n AS (SELECT round(sum(latency_ms * chunk_count / 1000.0e0), 2) AS latency_sum_s, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM members)
        SELECT n.latency_sum_s, n.chunks, b.le, CASE WHEN b.le = '+Inf' THEN n.chunks ELSE (SELECT CAST(coalesce(sum(chunk_count), 0) AS BIGINT) FROM members m WHERE m.chunk_count > 0 AND m.latency_ms / 1000.0e0 <= b.v) END AS n FROM b CROSS JOIN n""",
)
def weighted_latency(t):
    return agg.weighted_latency(t.members)


@query(
    "A17_compression_ratio",
    """WITH s AS (SELECT agent_id, sum(raw_bytes) AS r, sum(packed_bytes) AS p FROM members GROUP BY ROLLUP (agent_id))
       SELECT coalesce(agent_id, 'all') AS agent_id, CASE WHEN r > 0 AND p > 0 THEN round(CAST(r AS DOUBLE) / p, 2) ELSE 1.0e0 END AS ratio FROM s""",
)
def compression_ratio(t):
    return agg.compression_ratio(t.members)


_ASSIGNED = "g AS (SELECT DISTINCT event_type AS topic, CAST(user_id AS INT) AS part, 'a' || (event_id % 2) AS agent FROM events)"


def _assigned(t):
    return t.events.select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("int").alias("part"),
        F.concat(F.lit("a"), F.col("event_id") % 2).alias("agent"),
    )


@query(
    "A18_partition_layout",
    f"""WITH {_ASSIGNED}, o AS (SELECT topic, part, count(DISTINCT agent) AS n FROM g GROUP BY ALL)
        SELECT topic, max(part) + 1 AS partitions, CAST(max(part) + 1 - count(*) AS BIGINT) AS unassigned, count(*) FILTER (WHERE n > 1) AS duplicated FROM o GROUP BY topic""",
)
def partition_layout(t):
    return agg.partition_layout(_assigned(t))


@query(
    "A18_partition_owners",
    f"""WITH {_ASSIGNED}, s AS (SELECT topic, max(part) AS last FROM g GROUP BY topic), c AS (SELECT topic, CAST(unnest(range(last + 1)) AS INT) AS part FROM s)
        SELECT c.topic, c.part, g.agent FROM c LEFT JOIN g ON c.topic = g.topic AND c.part = g.part""",
)
def partition_owners(t):
    return agg.partition_owners(_assigned(t))


@query("A18_partitions_per_agent", f"WITH {_ASSIGNED} SELECT agent, count(*) AS partitions FROM g GROUP BY agent")
def partitions_per_agent(t):
    return agg.partitions_per_agent(_assigned(t).distinct())


@query(
    "A19_counter_total",
    f"""WITH l AS (SELECT *, lag(messages) OVER (PARTITION BY site, agent ORDER BY seq) AS p FROM samples),
        a AS (SELECT site, agent, CAST(sum(CASE WHEN messages < p THEN p ELSE 0 END) AS BIGINT) + arg_max(messages, seq) AS m, arg_max(lag_ms, seq) AS lag, max(ts_s) * 1000 AS seen FROM l GROUP BY site, agent)
        SELECT site, CAST(sum(m) AS BIGINT) AS messages, coalesce(max(lag) FILTER (WHERE seen >= {NOW_S - 7200}000 - 30000), 0) AS max_lag_ms FROM a GROUP BY site""",
)
def counter_total(t):
    rows = t.samples.withColumn("ts_ms", F.col("ts_s") * 1000)
    return agg.counter_total(rows, block_of(F.col("seq")), (NOW_S - 7200) * 1000)


@query("A20_count_by", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def count_by(t):
    return agg.count_by(t.orders, ["o_orderpriority"])


@query(
    "A20_sum_by_region",
    """SELECT r_name, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def sum_by_region(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    located = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        located.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(F.round(F.sum("spent"), 2).alias("amount"))
    )


@query(
    "A21_user_activity",
    """SELECT user_id, count(*) AS actions, max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) AS last_seen_s FROM events GROUP BY user_id ORDER BY actions DESC, user_id LIMIT 100""",
)
def activity(t):
    return user_activity(t.events)


@query(
    "A22_request_counts",
    """SELECT 'c' || (id % 3) AS cluster, status, count(*) AS n FROM statements GROUP BY 1, 2""",
)
def request_counts(t):
    rows = t.statements.withColumn("cluster", F.concat(F.lit("c"), F.col("id") % 3))
    return agg.count_by(rows, ["cluster", "status"])


@query(
    "A23_ratio",
    """SELECT source_cluster, round(count(*) FILTER (WHERE status = 'FAILED') * 100.0e0 / nullif(count(*) FILTER (WHERE status IN ('FAILED', 'COMPLETED')), 0), 4) AS percent FROM jobs GROUP BY source_cluster""",
)
def ratio(t):
    return agg.ratio(
        t.jobs, F.col("status") == "FAILED", F.col("status").isin("FAILED", "COMPLETED"), ["source_cluster"]
    )


@query("A24_max_by_group", "SELECT site, kind, max(lag_ms) AS max_lag_ms FROM samples GROUP BY site, kind")
def max_by_group(t):
    return agg.max_or_zero(t.samples, ["site", "kind"], "lag_ms")


@query(
    "A25_run_metrics",
    """SELECT job_id, run_number, round(greatest(0.1e0, (ended_us - started_us) / 1000000.0e0), 3) AS seconds,
       round(bytes / 1048576.0e0 / greatest(0.1e0, (ended_us - started_us) / 1000000.0e0), 2) AS mb_s FROM runs""",
)
def run_metrics(t):
    return agg.run_metrics(t.runs)


@query(
    "A25_run_history",
    """SELECT job_id, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY job_id""",
)
def run_history(t):
    return agg.run_history(t.runs)


@query(
    "A26_members_per_cluster",
    "SELECT coalesce(cluster_id, '-') AS cluster, count(*) AS total, count(*) FILTER (WHERE lower(status) = 'online') AS online FROM members GROUP BY 1",
)
def members_per_cluster(t):
    return agg.members_per_cluster(t.members)

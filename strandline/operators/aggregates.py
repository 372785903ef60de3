"""Totals, histograms and ratios; every one is a partial and a final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import display
from strandline.operators.ordered import neighbour

# Histogram bounds.
SIZE_BOUNDS = (1_048_576, 10_485_760, 104_857_600, 1_073_741_824, 10_737_418_240)
DURATION_BOUNDS_S = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)
LATENCY_BOUNDS_S = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
LAG_FRESH_MS = 30_000


def _sum0(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _sum_if(condition: Column, value: Column) -> Column:
    return _sum0(F.when(condition, value).otherwise(F.lit(0)))


def aggregate_subjobs(jobs: DataFrame) -> DataFrame:
    """Per parent: number, bytes in all and copied, active ones, first start, last end."""
    return jobs.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        _sum0(F.col("total_bytes")).alias("total_bytes"),
        _sum0(F.col("copied_bytes")).alias("copied_bytes"),
        F.count_if(F.upper("status").isin("RUNNING", "QUEUED")).alias("active"),
        F.min("started_s").alias("first_started_s"),
        F.max("completed_s").alias("last_completed_s"),
    )


def root_job_stats(jobs: DataFrame) -> DataFrame:
    """Total, active, frozen, failed, and bytes still to copy."""
    state = F.upper("status")
    left = F.col("total_bytes") - F.col("copied_bytes")
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state.isin("RUNNING", "STREAMING")).alias("active"),
        F.count_if(state.isin("STOPPED", "CANCELLED")).alias("frozen"),
        F.count_if(state == "FAILED").alias("failed"),
        _sum_if(left > 0, left).alias("remaining_bytes"),
    )


def bytes_by_status(jobs: DataFrame) -> DataFrame:
    """Bytes per state: all of them for completed jobs, the copied ones otherwise."""
    state = F.lower("status")
    moved = F.when(state == "completed", F.col("total_bytes")).otherwise(F.col("copied_bytes"))
    return jobs.groupBy(state.alias("status")).agg(_sum0(moved).alias("bytes"))


def cumulative_histogram(
    df: DataFrame, value: Column, bounds: Sequence[float], by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Rows (by.., le, n): how many values are at most each bound, and ``+Inf`` for all."""
    w = F.lit(1) if weight is None else weight
    labels = [*[str(b) for b in bounds], "+Inf"]
    counts = [_sum_if(value <= b, w) for b in bounds] + [_sum0(w)]
    wide = df.groupBy(*by).agg(*[c.cast("long").alias(f"b{i}") for i, c in enumerate(counts)])
    cells = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("n")) for i, le in enumerate(labels)])
    return wide.select(*by, F.inline(cells))


def size_histogram(files: DataFrame, size: str = "file_size", bounds: Sequence[int] = SIZE_BOUNDS) -> DataFrame:
    """Cumulative sizes with the number and the sum of all files on every row."""
    wide = files.agg(
        *[F.count_if(F.col(size) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("files"), _sum0(F.col(size)).alias("bytes"),
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("files").alias("n")))
    return wide.select("files", "bytes", F.inline(F.array(*cells)))


def pool_summary(tasks: DataFrame, key: str = "job_id") -> DataFrame:
    """Per job: tasks, objects, bytes, and the skipped objects and bytes."""
    skipped = F.col("status") == "SKIPPED"
    return tasks.groupBy(key).agg(
        F.count(F.lit(1)).alias("tasks"),
        _sum0(F.col("file_count")).alias("objects"),
        _sum0(F.col("file_size")).alias("bytes"),
        _sum_if(skipped, F.col("file_count")).alias("skipped_objects"),
        _sum_if(skipped, F.col("file_size")).alias("skipped_bytes"),
    )


def replication_totals(df: DataFrame, columns: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Sums of columns over the rows that match, 0 when none do."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[_sum0(F.col(c)).alias(c) for c in columns])


def topic_totals(jobs: DataFrame) -> DataFrame:
    state = F.upper("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(state == "ACTIVE").alias("active"),
        F.count_if(state == "PAUSED").alias("paused"),
        _sum0(F.col("messages")).alias("messages"),
        F.coalesce(F.max("lag_ms"), F.lit(0)).alias("max_lag_ms"),
    )


def active_sessions(sessions: DataFrame, cluster: Column, kind: Column, ended: Sequence[str]) -> DataFrame:
    """Sessions that have not ended, per cluster and bounded kind label."""
    return (
        sessions.filter(~F.upper("status").isin(*ended))
        .groupBy(cluster.alias("cluster"), kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def status_summary(df: DataFrame, states: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Row count, and one count per state, in one pass."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.upper("status") == s).alias(s.lower()) for s in states]
    )


def authors(df: DataFrame, column: str, n: int = 500) -> DataFrame:
    """Distinct non-blank names in order, at most ``n``."""
    return df.filter(F.trim(column) != "").select(column).distinct().orderBy(column).limit(n)


def directory_totals(manifest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, folders and bytes of the files."""
    is_file = F.col("kind") == "FILE"
    return manifest.groupBy(*by).agg(
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("kind") == "DIRECTORY").alias("folders"),
        _sum_if(is_file, F.col("size")).alias("bytes"),
    )


def branch_balance(queues: DataFrame, default_label: str = "DEFAULT") -> DataFrame:
    """Children's capacity per (parent, label): ok at 100, else over or under; others may sum to 0."""
    total = F.round(F.sum("capacity"), 2)
    sums = queues.groupBy("parent_path", "label").agg(total.alias("capacity"))
    spare = F.round(F.lit(100.0) - F.col("capacity"), 2)
    ok = (F.abs(spare) < 0.01) | ((F.col("label") != default_label) & (F.abs("capacity") < 0.01))
    status = (
        F.when(ok, F.lit("ok"))
        .when(F.col("capacity") > 100.0, F.lit("overallocated"))
        .otherwise(F.lit("underallocated"))
    )
    return sums.select("parent_path", "label", "capacity", spare.alias("unallocated"), status.alias("status"))


def max_or_zero(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.max(column), F.lit(0)).alias(f"max_{column}"))


def bootstrap_speed(jobs: DataFrame, now_s: int) -> DataFrame:
    """Sum of the parents' average speeds in bytes per second."""
    per_parent = aggregate_subjobs(jobs).filter(
        (F.col("copied_bytes") > 0) & F.col("first_started_s").isNotNull()
    )
    elapsed = F.greatest(F.lit(1), F.lit(now_s) - F.col("first_started_s"))
    return per_parent.agg(F.round(F.coalesce(F.sum(F.col("copied_bytes") / elapsed), F.lit(0.0)), 3).alias("bytes_s"))


def weighted_latency(agents: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS_S) -> DataFrame:
    """Buckets of chunk latency weighted by chunk count, with the latency sum and chunk count."""
    seconds = F.col("latency_ms") / 1000.0
    n = F.col("chunk_count")
    wide = agents.agg(
        F.round(F.coalesce(F.sum(F.col("latency_ms") * n / 1000.0), F.lit(0.0)), 2).alias("latency_sum_s"),
        _sum0(n).alias("chunks"),
        *[_sum_if((n > 0) & (seconds <= b), n).alias(f"b{i}") for i, b in enumerate(bounds)],
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("chunks").alias("n")))
    return wide.select("latency_sum_s", "chunks", F.inline(F.array(*cells)))


def compression_ratio(agents: DataFrame) -> DataFrame:
    """Raw over packed bytes per member and over all (``all``), 1.0 when unknown."""
    sums = agents.rollup("agent_id").agg(_sum0(F.col("raw_bytes")).alias("raw"), _sum0(F.col("packed_bytes")).alias("packed"))
    ratio = F.when((F.col("raw") > 0) & (F.col("packed") > 0), F.round(F.col("raw") / F.col("packed"), 2)).otherwise(
        F.lit(1.0)
    )
    return sums.select(F.coalesce("agent_id", F.lit("all")).alias("agent_id"), ratio.alias("ratio"))


def partition_layout(assigned: DataFrame) -> DataFrame:
    """Per topic: partitions 0..max, how many have no owner and how many have several.

    The distinct (topic, part, agent) rows are counted, never gathered in a list.
    """
    owners = assigned.groupBy("topic", "part").agg(F.countDistinct("agent").alias("owners"))
    return owners.groupBy("topic").agg(
        (F.max("part") + 1).alias("partitions"),
        (F.max("part") + 1 - F.count(F.lit(1))).alias("unassigned"),
        F.count_if(F.col("owners") > 1).alias("duplicated"),
    )


def partition_owners(assigned: DataFrame) -> DataFrame:
    """One row per (topic, part, owner); a partition without an owner has a NULL one."""
    sizes = assigned.groupBy("topic").agg(F.max("part").alias("last"))
    cells = sizes.select("topic", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
    return cells.join(assigned.select("topic", "part", "agent").distinct(), ["topic", "part"], "left")


def partitions_per_agent(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("agent").agg(F.count(F.lit(1)).alias("partitions"))


def counter_total(samples: DataFrame, block: Column, now_ms: int) -> DataFrame:
    """Per site: messages across restarts, and the largest lag among members seen lately.

    A counter below its previous value has restarted: the previous value is added
    to the base.  ``samples`` are (site, agent, seq, ts_ms, messages, lag_ms).
    """
    keys = ["site", "agent"]
    shown = F.greatest(F.lit(0), F.col("messages"))
    steps = neighbour(samples, keys, ["seq"], block, {"before": shown})
    restarted = F.when(shown < F.col("before"), F.col("before")).otherwise(F.lit(0))
    per_agent = steps.groupBy(*keys).agg(
        (F.sum(restarted) + F.max_by(shown, "seq")).alias("messages"),
        F.max_by(F.greatest(F.lit(0), F.col("lag_ms")), "seq").alias("lag_ms"),
        F.max("ts_ms").alias("seen_ms"),
    )
    fresh = F.col("seen_ms") >= now_ms - LAG_FRESH_MS
    return per_agent.groupBy("site").agg(
        F.sum("messages").alias("messages"),
        F.coalesce(F.max(F.when(fresh, F.col("lag_ms"))), F.lit(0)).alias("max_lag_ms"),
    )


def count_by(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name))


def ratio(df: DataFrame, part: Column, whole: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in percent, NULL when nothing is in the whole."""
    n, d = F.count_if(part & whole), F.count_if(whole)
    return df.groupBy(*by).agg(F.round(n * 100.0 / F.nullif(d, F.lit(0)), 4).alias("percent"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Seconds of a run (at least 0.1) and its average MB per second."""
    seconds = F.greatest(F.lit(0.1), (F.col("ended_us") - F.col("started_us")) / 1_000_000.0)
    speed = F.round(F.col("bytes") / display.MB / seconds, 2)
    return runs.select("job_id", "run_number", F.round(seconds, 3).alias("seconds"), speed.alias("mb_s"))


def run_history(runs: DataFrame) -> DataFrame:
    """Per job: completed and failed runs and bytes moved."""
    return runs.groupBy("job_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        _sum0(F.col("bytes")).alias("bytes"),
    )


def members_per_cluster(members: DataFrame) -> DataFrame:
    """Members in all and online per cluster; a missing cluster is a dash."""
    return (
        members.groupBy(F.coalesce("cluster_id", F.lit("-")).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("status") == "online").alias("online"))
        .orderBy("cluster")
    )

"""Comparisons and lookups between two tables, each as an equi join.

No operator forms all pairs of a group: where one partner per row is wanted, the
other side is reduced to the few candidates that can win before the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import names, paths
from strandline.operators.ordered import first_per_key, running

TIME_BLOCK_MS = 60_000


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """What to copy: every source file, SKIPPED when the target's is up to date, else QUEUED."""
    there = target.select(
        "rel_path", F.col("size").alias("t_size"), F.col("mtime_s").alias("t_mtime"), F.lit(True).alias("there")
    )
    fresh = paths.is_up_to_date(
        F.coalesce(F.col("there"), F.lit(False)), F.col("size"), F.col("mtime_s"), F.col("t_size"), F.col("t_mtime")
    )
    return source.join(there, "rel_path", "left").select(
        "rel_path", "size", F.when(fresh, F.lit("SKIPPED")).otherwise(F.lit("QUEUED")).alias("action")
    )


def extraneous(target: DataFrame, source: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Target rows whose key the source does not have; ``keep`` bounds what may be dropped."""
    candidates = target if keep is None else target.filter(keep)
    return candidates.join(source.select(*keys), list(keys), "left_anti")


def extraneous_partitions(target: DataFrame, source: DataFrame, name: str = "part_name") -> DataFrame:
    """Target partitions whose list of values the source does not have."""
    values = lambda df: df.withColumn("values", paths.partition_values(F.col(name)))
    keys = ["db", "table_name", "values"]
    return values(target).join(values(source).select(*keys), keys, "left_anti")


def schema_drift(src_cols: DataFrame, tgt_cols: DataFrame, src_tables: DataFrame, tgt_tables: DataFrame) -> DataFrame:
    """One row per discrepancy between a source table and the target's: (table_name, issue, detail).

    Columns are matched ignoring case and types ignoring white space and case; a
    format that either side does not report is not compared.
    """
    s, t = src_tables.alias("s"), tgt_tables.alias("t")
    both = s.join(t, F.col("s.table_name") == F.col("t.table_name"), "full")

    def differs(field: str, label: str, *, ignore_case: bool) -> Column:
        a, b = F.col(f"s.{field}"), F.col(f"t.{field}")
        changed = (F.lower(a) != F.lower(b)) if ignore_case else ~a.eqNullSafe(b)
        return F.when(
            changed, F.struct(F.lit(label).alias("issue"), F.concat_ws(" -> ", a, b).alias("detail"))
        )

    table_issues = F.when(
        F.col("s.table_name").isNull(),
        F.array(F.struct(F.lit("EXTRA_TABLE").alias("issue"), F.lit("").alias("detail"))),
    ).when(
        F.col("t.table_name").isNull(),
        F.array(F.struct(F.lit("MISSING_TABLE").alias("issue"), F.lit("").alias("detail"))),
    ).otherwise(
        F.array_compact(
            F.array(
                differs("table_type", "TABLE_TYPE", ignore_case=False),
                differs("partition_keys", "PARTITION_KEYS", ignore_case=False),
                differs("serde", "SERDE", ignore_case=True),
                differs("input_format", "INPUT_FORMAT", ignore_case=True),
                differs("output_format", "OUTPUT_FORMAT", ignore_case=True),
            )
        )
    )
    of_tables = both.select(
        F.coalesce(F.col("s.table_name"), F.col("t.table_name")).alias("table_name"),
        F.explode(table_issues).alias("i"),
    ).select("table_name", "i.issue", "i.detail")
    return of_tables.unionByName(column_drift(src_cols, tgt_cols, src_tables, tgt_tables))


def column_drift(
    src_cols: DataFrame, tgt_cols: DataFrame, src_tables: DataFrame | None = None, tgt_tables: DataFrame | None = None
) -> DataFrame:
    """Missing, extra and differently typed columns of the tables on both sides."""
    if src_tables is not None and tgt_tables is not None:
        src_cols = src_cols.join(tgt_tables, "table_name", "left_semi")
        tgt_cols = tgt_cols.join(src_tables, "table_name", "left_semi")
    s = src_cols.withColumn("key", F.lower("column_name")).alias("s")
    t = tgt_cols.withColumn("key", F.lower("column_name")).alias("t")
    joined = s.join(t, (F.col("s.table_name") == F.col("t.table_name")) & (F.col("s.key") == F.col("t.key")), "full")
    s_type, t_type = F.col("s.column_type"), F.col("t.column_type")
    issue = (
        F.when(F.col("t.key").isNull(), F.lit("MISSING_COLUMN"))
        .when(F.col("s.key").isNull(), F.lit("EXTRA_COLUMN"))
        .when(names.norm_type(s_type) != names.norm_type(t_type), F.lit("COLUMN_TYPE"))
    )
    return joined.select(
        F.coalesce(F.col("s.table_name"), F.col("t.table_name")).alias("table_name"),
        issue.alias("issue"),
        F.concat(
            F.coalesce(F.col("s.column_name"), F.col("t.column_name")), F.lit(": "), F.concat_ws(" -> ", s_type, t_type)
        ).alias("detail"),
    ).filter(F.col("issue").isNotNull())


def drift_report(issues: DataFrame, limit: int = 2000) -> DataFrame:
    """One message per table, its issues in order joined by ``"; "`` and cut to ``limit``.

    An issue takes at least 8 characters with its separator, so the first
    ``limit / 8`` issues of a table always fill the message; only those are
    gathered, and map tasks send no more than that: where it takes it, the session's
    bound on group limits before a shuffle is raised to that number.
    """
    issues_shown, bound = limit // 8 + 1, "spark.sql.optimizer.windowGroupLimitThreshold"
    if issues_shown > int(issues.sparkSession.conf.get(bound)):
        issues.sparkSession.conf.set(bound, issues_shown)
    text = F.concat_ws(" ", "issue", "detail")
    head = first_per_key(issues.withColumn("text", text), ["table_name"], [F.col("text")], n=issues_shown)
    joined = F.array_join(F.array_sort(F.collect_list("text")), "; ")
    counts = issues.groupBy("table_name").agg(F.count(F.lit(1)).alias("issues"))
    messages = head.groupBy("table_name").agg(joined.alias("full"))
    cut = F.when(F.length("full") > limit, F.concat(F.substring("full", 1, limit - 3), F.lit("..."))).otherwise(
        F.col("full")
    )
    return counts.join(messages, "table_name").select("table_name", "issues", cut.alias("message"))


def config_diff(draft: DataFrame, live: DataFrame, default_label: str = "DEFAULT") -> DataFrame:
    """Draft against live at (path, label): created, deleted, modified or unchanged, with deltas.

    Only the drafted paths are reported.  A path whose labels are all equal gives
    one row under the default label, modified when another property changed.  What
    concerns a whole path is taken over its few labels by a window, so the two
    tables are joined once.
    """
    props = ["capacity", "max_capacity", "state", "policy", "node_labels"]
    d = draft.select("path", "label", F.lower("action").alias("action"), *[F.col(c).alias(f"d_{c}") for c in props])
    lv = live.select("path", "label", F.lit(True).alias("on_live"), *[F.col(c).alias(f"l_{c}") for c in props])
    cells = d.join(lv, ["path", "label"], "full")

    delta = lambda c: F.col(f"d_{c}") - F.col(f"l_{c}")
    one_side = F.col("action").isNull() != F.col("on_live").isNull()
    moved = (F.abs(delta("capacity")) > 0.01) | (F.abs(delta("max_capacity")) > 0.01)
    cells = cells.withColumn("changed", one_side | F.coalesce(moved, F.lit(False)))

    path = Window.partitionBy("path")
    at_default = F.col("label") == default_label
    over_path = lambda c: F.max(c).over(path)
    cells = cells.select(
        "*",
        over_path(F.col("action").isNotNull()).alias("drafted"),
        over_path(F.coalesce(F.col("action") == "delete", F.lit(False))).alias("is_delete"),
        over_path(F.col("on_live").isNotNull()).alias("known"),
        over_path("changed").alias("any_changed"),
        F.min("label").over(path).alias("first_label"),
        *[F.min(f"{side}_{c}").over(path).alias(f"p_{side}_{c}") for side in "dl" for c in props[2:]],
        *[over_path(F.when(at_default, F.col(f"{s}_{c}"))).alias(f"z_{s}_{c}") for s in "dl" for c in props[:2]],
    ).filter("drafted")

    label_set = lambda c: F.array_sort(F.split(F.col(c), ","))
    props_changed = (
        ~F.col("p_d_state").eqNullSafe(F.col("p_l_state"))
        | F.coalesce(F.lower("p_d_policy") != F.lower("p_l_policy"), F.lit(False))
        | F.coalesce(label_set("p_d_node_labels") != label_set("p_l_node_labels"), F.lit(False))
    )
    whole = F.col("is_delete") | (F.col("known") & ~F.col("any_changed"))
    whole_action = (
        F.when(F.col("is_delete"), F.lit("deleted"))
        .when(props_changed, F.lit("modified"))
        .otherwise(F.lit("unchanged"))
    )
    number = lambda c: F.when(whole, F.col(f"z_{c}")).otherwise(F.col(c))
    shown = F.when(whole, F.col("label") == F.col("first_label")).otherwise(~F.col("known") | F.col("changed"))
    return cells.filter(shown).select(
        "path",
        F.when(whole, F.lit(default_label)).otherwise(F.col("label")).alias("label"),
        F.when(whole, whole_action).when(F.col("known"), F.lit("modified")).otherwise(F.lit("created")).alias("action"),
        number("l_capacity").alias("live_capacity"),
        number("d_capacity").alias("draft_capacity"),
        F.round(number("d_capacity") - number("l_capacity"), 2).alias("delta_capacity"),
        F.round(number("d_max_capacity") - number("l_max_capacity"), 2).alias("delta_max_capacity"),
    )


def mirror_routes(jobs: DataFrame) -> DataFrame:
    """For each job the first other job that runs the same route backwards, if any."""
    keyed = jobs.withColumn("src", names.norm_id(F.col("source_cluster"))).withColumn(
        "tgt", names.norm_id(F.col("target_cluster"))
    )
    route = ["src", "tgt", "source_path", "target_path"]
    two = first_per_key(keyed.select("id", *route), route, [F.col("id")], n=2)
    ends = two.groupBy(*route).agg(F.min("id").alias("first_id"), F.max("id").alias("second_id"))
    back = ends.select(
        F.col("src").alias("tgt"), F.col("tgt").alias("src"),
        F.col("source_path").alias("target_path"), F.col("target_path").alias("source_path"),
        "first_id", "second_id",
    )
    other = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).when(
        F.col("second_id") != F.col("id"), F.col("second_id")
    )
    return keyed.join(back, route, "left").select(
        "id", other.alias("mirror_id"), other.isNotNull().alias("has_mirror")
    )


def legs(source: Column, target: Column, direction: Column) -> Column:
    """Directions of a job as ``a->b`` texts; both for a two-way job."""
    a, b = F.lower(F.trim(source)), F.lower(F.trim(target))
    forward, back = F.concat(a, F.lit("->"), b), F.concat(b, F.lit("->"), a)
    both = F.array_distinct(F.array(forward, back))
    return F.when(F.upper(direction) == "BIDIRECTIONAL", both).otherwise(F.array(forward))


def find_overlaps(jobs: DataFrame, active_only: bool = False) -> DataFrame:
    """For each job the first other job sharing a direction and a topic, with the shared topics.

    Per (direction, topic) only the two first jobs can be the answer, so no pairs
    of a popular topic are formed.  ``jobs`` has an array column ``topics``.
    """
    base = jobs.select(
        "id", "status", F.array_distinct("topics").alias("topics"),
        legs(F.col("source_dc"), F.col("target_dc"), F.col("direction")).alias("legs"),
    )
    cells = base.select("id", "status", F.explode("legs").alias("leg"), "topics").select(
        "id", "status", "leg", F.explode("topics").alias("topic")
    )
    others = cells.filter(F.upper("status") == "ACTIVE") if active_only else cells
    two = first_per_key(others.select("id", "leg", "topic"), ["leg", "topic"], [F.col("id")], n=2)
    ends = two.groupBy("leg", "topic").agg(F.min("id").alias("first_id"), F.max("id").alias("second_id"))
    other = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).when(
        F.col("second_id") != F.col("id"), F.col("second_id")
    )
    found = (
        cells.join(ends, ["leg", "topic"])
        .select("id", other.alias("other_id"))
        .filter(F.col("other_id").isNotNull())
        .groupBy("id")
        .agg(F.min("other_id").alias("other_id"))
    )
    mine = base.select("id", F.col("topics").alias("mine"))
    theirs = base.select(F.col("id").alias("other_id"), F.col("topics").alias("theirs"))
    return (
        found.join(mine, "id")
        .join(theirs, "other_id")
        .select("id", "other_id", F.array_sort(F.array_intersect("mine", "theirs")).alias("shared_topics"))
    )


def without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left table that have no match (jobs without runs)."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def running_jobs(jobs: DataFrame, parents: DataFrame, cluster: str | None) -> DataFrame:
    """Running jobs of a cluster whose parent is not halted."""
    live = jobs.filter(F.col("status").isin("RUNNING", "STREAMING"))
    if cluster is not None:
        live = live.filter(F.lower("source_cluster") == cluster.lower())
    halted = parents.filter(F.col("status").isin("PAUSED", "STOPPED")).select(F.col("id").alias("parent_id"))
    return live.join(halted, "parent_id", "left_anti")


def claimable_tasks(tasks: DataFrame, jobs: DataFrame, parents: DataFrame, cluster: str | None = None) -> DataFrame:
    """Queued tasks of running jobs whose parent is not halted, oldest first."""
    owners = running_jobs(jobs, parents, cluster).select(F.col("id").alias("job_id"))
    return tasks.filter(F.col("status") == "QUEUED").join(owners, "job_id", "left_semi").orderBy("updated_s")


def ready_to_finalize(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Running non-streaming jobs with every object accounted for and no task open."""
    done = F.col("transferred") + F.col("skipped") + F.col("failed") >= F.col("total_objects")
    candidates = jobs.filter(
        (F.col("status") == "RUNNING")
        & (F.col("sync_mode").isNull() | (F.col("sync_mode") != "STREAMING_INOTIFY"))
        & (F.col("total_objects") > 0)
        & done
    )
    open_tasks = tasks.filter(F.col("status").isin("QUEUED", "RUNNING")).select(F.col("job_id").alias("id"))
    return candidates.join(open_tasks, "id", "left_anti")


def pending_for_cluster(tasks: DataFrame, jobs: DataFrame, cluster: str, status: str = "QUEUED") -> DataFrame:
    """Tasks in a state whose job has the cluster on either side."""
    c = cluster.lower()
    touching = jobs.filter((F.lower("source_cluster") == c) | (F.lower("target_cluster") == c))
    return tasks.filter(F.col("status") == status).join(
        touching.select(F.col("id").alias("job_id")), "job_id", "left_semi"
    )


def with_counts(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Number of child rows per row, 0 when there are none."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def offsets_for_times(requests: DataFrame, log: DataFrame, block_ms: int = TIME_BLOCK_MS) -> DataFrame:
    """Add ``target_offset``: the smallest one at or after the time of each (topic, part, ts_ms) request.

    A forward as-of join as a running minimum from the newest time back, in time
    blocks, so a hot partition is spread over many tasks. Both sides are first reduced to
    one row per partition and millisecond, in the map tasks already, so a block of a
    partition holds no more than ``2 * block_ms`` rows, however many were written in it.
    """
    at = ["topic", "part", "ts_ms"]
    asked = requests.select(*at).distinct().withColumn("__side", F.lit(0))
    written = log.groupBy(*at).agg(F.min("rec_offset").alias("__offset")).withColumn("__side", F.lit(1))
    block = F.floor(F.col("ts_ms") / block_ms).cast("long")
    out = running(
        asked.unionByName(written, allowMissingColumns=True), ["topic", "part"], ["ts_ms", "__side"], block,
        {"target_offset": ("min", F.col("__offset"))}, descending=True,
    )
    found = out.filter(F.col("__side") == 0).select(*[F.col(c).alias(f"__{c}") for c in at], "target_offset")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at]
    return requests.join(found, same, "left").select(*requests.columns, "target_offset")


def translate_offsets(groups: DataFrame, exact: DataFrame, last: DataFrame) -> DataFrame:
    """Time of a group's committed offset.

    The exact time where the offset is known, else the partition's last time but
    only once the group has read everything, else 0.
    """
    tp = ["topic", "part"]
    known = exact.select(*tp, F.col("rec_offset").alias("committed"), F.col("ts_ms").alias("exact_ms"))
    ends = last.select(*tp, F.col("ts_ms").alias("last_ms"), "end_offset")
    caught_up = F.when(F.col("committed") >= F.col("end_offset"), F.col("last_ms"))
    ts = F.when(F.col("exact_ms") > 0, F.col("exact_ms")).otherwise(F.coalesce(caught_up, F.lit(0)))
    return (
        groups.join(known, [*tp, "committed"], "left").join(ends, tp, "left")
        .select("group_id", *tp, "committed", ts.cast("long").alias("ts_ms"))
    )


def apply_offsets(current: DataFrame, proposed: DataFrame, live: DataFrame, force: bool = False) -> DataFrame:
    """Offsets to commit: never back, and not for active or unknown groups unless forced."""
    keys = ["group_id", "topic", "part"]
    joined = proposed.filter(F.col("target_offset") >= 0).join(
        current.select(*keys, F.col("committed").alias("current_offset")), keys, "left"
    ).join(live.select("group_id", "liveness"), "group_id", "left")
    if force:
        return joined.select(*keys, "target_offset")
    forward = F.col("current_offset").isNull() | (F.col("target_offset") >= F.col("current_offset"))
    idle = F.coalesce(F.col("liveness"), F.lit("UNKNOWN")) == "INACTIVE"
    return joined.filter(forward & idle).select(*keys, "target_offset")


def map_schema_ids(records: DataFrame, id_map: DataFrame) -> DataFrame:
    """Target schema id of each record by (topic, source id); ``id_missing`` marks the dead letters."""
    ids = id_map.select("topic", "source_id", F.col("target_id"))
    return records.join(ids, ["topic", "source_id"], "left").withColumn(
        "id_missing", F.col("source_id").isNotNull() & F.col("target_id").isNull()
    )


def route_partitions(parts: DataFrame, routes: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Endpoint of each (topic, part): a topic's route bounds the pool, no endpoint left is NO_TARGET.

    ``pool`` is the configured endpoint list; ``routes`` has (topic, endpoints ARRAY).
    """
    everything = F.array(*[F.lit(p) for p in pool])
    joined = parts.join(routes.select("topic", F.col("endpoints").alias("route")), "topic", "left")
    open_route = F.col("route").isNull() | (F.size("route") == 0)
    usable = F.when(open_route, everything).otherwise(
        F.filter(everything, lambda e: F.array_contains(F.col("route"), e))
    )
    picked = F.element_at(usable, (F.pmod(F.col("part"), F.size(usable)) + 1).cast("int"))
    return joined.select(
        "topic", "part", F.when(F.size(usable) == 0, F.lit("NO_TARGET")).otherwise(picked).alias("endpoint")
    )


def _text_hash(text: str) -> int:
    """32-bit polynomial hash (base 31) of the UTF-16 units, signed."""
    units = np.frombuffer(text.encode("utf-16-be"), dtype=">u2")
    total = reduce(lambda acc, unit: (acc * 31 + int(unit)) & 0xFFFFFFFF, units, 0)
    return total - 2**32 if total >= 2**31 else total


# Multipliers of the 64-bit mixing function.
SPREAD = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53


def _weight(part: np.ndarray, endpoint_hash: int) -> np.ndarray:
    """Signed 64-bit rendezvous weight of every partition number for one endpoint."""
    spread = np.uint64((endpoint_hash * SPREAD) % 2**64)
    h = (part.astype(np.int64).astype(np.uint64) << np.uint64(32)) ^ spread
    for factor in (MIX_1, MIX_2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(33))).astype(np.int64)


def hrw_assign(parts: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """Endpoint with the highest rendezvous weight for each partition number.

    ``endpoints`` is the configured list of healthy receivers.  Weights wrap at 64
    bits, which no built-in expression does, so they are computed by numpy on
    Arrow batches; one pass per endpoint, and no row is multiplied.
    """
    hashes = [_text_hash(e) for e in endpoints]

    @F.pandas_udf(T.IntegerType())
    def best(part: pd.Series) -> pd.Series:
        numbers = part.to_numpy()
        top = np.full(len(numbers), np.iinfo(np.int64).min)
        index = np.zeros(len(numbers), dtype=np.int32)
        with np.errstate(over="ignore"):
            for i, h in enumerate(hashes):
                w = _weight(numbers, h)
                better = w > top
                top, index = np.where(better, w, top), np.where(better, i, index)
        return pd.Series(index)

    listed = F.array(*[F.lit(e) for e in endpoints])
    return parts.withColumn("endpoint", F.element_at(listed, best(F.col("part")) + 1))


def site_status(sites: DataFrame, agents: DataFrame) -> DataFrame:
    """ONLINE, DEGRADED, OFFLINE or UNKNOWN per site from its agents."""
    counts = (
        agents.groupBy(names.norm_id(F.col("cluster_id")).alias("key"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("status") == "online").alias("online"))
        .filter(F.col("key").isNotNull())
    )
    total, online = (F.coalesce(F.col(c), F.lit(0)) for c in ("total", "online"))
    status = (
        F.when((online > 0) & (online < total), F.lit("DEGRADED"))
        .when(online > 0, F.lit("ONLINE"))
        .when(total > 0, F.lit("OFFLINE"))
        .otherwise(F.lit("UNKNOWN"))
    )
    return (
        sites.withColumn("key", names.norm_id(F.col("site_id"))).join(counts, "key", "left")
        .select("site_id", online.alias("online"), total.alias("total"), status.alias("status"))
    )


def cluster_status(clusters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job counts by state per cluster, with zeros for a cluster without jobs."""
    state = F.upper("status")
    counts = jobs.groupBy(names.norm_id(F.col("source_cluster")).alias("key")).agg(
        F.count_if(state.isin("RUNNING", "STREAMING")).alias("active"),
        F.count_if(state.isin("QUEUED", "ANALYZING")).alias("queued"),
        F.count_if(state == "FAILED").alias("failed"),
        F.count_if(state == "COMPLETED").alias("completed"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("active", "queued", "failed", "completed")]
    return clusters.withColumn("key", names.norm_id(F.col("site_id"))).join(counts, "key", "left").select(
        "site_id", *zero
    )


def stale_files(target_files: DataFrame, event_files: DataFrame) -> DataFrame:
    """Top-level files of an overwritten folder that the overwrite did not write.

    Both have (folder, name); ``event_files`` are the files listed by the event.
    """
    overwritten = event_files.select("folder").distinct()
    return (
        target_files.filter(~F.col("name").contains("/"))
        .join(overwritten, "folder", "left_semi")
        .join(event_files, ["folder", "name"], "left_anti")
    )


def topic_conflicts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Settings of a topic that break replication: other cleanup policy, smaller record limit."""
    s, t = source.alias("s"), target.alias("t")
    policy = lambda side: F.array_sort(F.transform(F.split(F.col(f"{side}.cleanup_policy"), ","), lambda x: F.trim(x)))
    found = F.array_compact(
        F.array(
            F.when(policy("s") != policy("t"), F.lit("cleanup.policy")),
            F.when(F.col("t.max_message_bytes") < F.col("s.max_message_bytes"), F.lit("max.message.bytes")),
        )
    )
    return s.join(t, F.col("s.topic") == F.col("t.topic")).select(
        F.col("s.topic").alias("topic"), F.explode(found).alias("conflict")
    )


def remove_subtrees(live: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that are neither a deleted dotted path nor below one.

    Each path is matched by its own parents, an equi join instead of a prefix join.
    """
    doomed = (
        live.select("path", F.explode(paths.dotted_ancestors(F.col("path"))).alias("above"))
        .join(deleted.select(F.col("path").alias("above")), "above", "left_semi")
        .select("path")
    )
    return live.join(doomed, "path", "left_anti")


def merge_config(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Live (path, label) capacities with deletes, creates and overrides of a draft applied."""
    kept = remove_subtrees(live, changes.filter(F.col("action") == "delete").select("path").distinct())
    upserts = changes.filter(F.col("action") != "delete").select(
        "path", "label", F.col("capacity").alias("new_capacity")
    )
    merged = kept.select("path", "label", "capacity").join(upserts, ["path", "label"], "full")
    return merged.select("path", "label", F.coalesce("new_capacity", "capacity").alias("capacity"))


def validate_changes(changes: DataFrame, live: DataFrame) -> DataFrame:
    """First structural error of each change: action, parent, already there, not there."""
    known = live.select("path").distinct().withColumn("known", F.lit(True))
    action = F.lower(F.coalesce(F.col("action"), F.lit("modify")))
    expected = F.regexp_replace("path", r"\.[^.]*$", "")
    there = F.coalesce(F.col("known"), F.lit(False))
    wrong_name = F.col("name").isNotNull() & ~F.endswith(F.col("path"), F.concat(F.lit("."), F.col("name")))
    error = (
        F.when(F.trim(F.coalesce("path", F.lit(""))) == "", F.lit("NO_PATH"))
        .when(~action.isin("create", "modify", "delete"), F.lit("UNKNOWN_ACTION"))
        .when((F.col("path") == "root") & (action != "modify"), F.lit("ROOT_IS_FIXED"))
        .when((F.col("path") != "root") & (F.col("parent_path") != expected), F.lit("WRONG_PARENT"))
        .when((F.col("path") != "root") & wrong_name, F.lit("WRONG_NAME"))
        .when((action == "create") & there, F.lit("ALREADY_EXISTS"))
        .when((action != "create") & ~there, F.lit("NOT_FOUND"))
    )
    return changes.join(known, "path", "left").select("path", "label", error.alias("error")).filter(
        F.col("error").isNotNull()
    )


def reusable(requests: DataFrame, jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing job with the same keys for each request, NULL where one must be made."""
    existing = jobs.groupBy(*keys).agg(F.min("id").alias("existing_id"))
    return requests.join(existing, list(keys), "left")


def barrier(meta: DataFrame, copies: DataFrame, key: str = "id") -> DataFrame:
    """Whether a metadata row may be applied: all its data copies are done (or there are none)."""
    state = copies.groupBy(key).agg(F.min(F.col("status").isin("COMPLETED", "SKIPPED")).alias("all_done"))
    return meta.join(state, key, "left").withColumn("ready", F.coalesce("all_done", F.lit(True))).drop("all_done")


def reconcile_deletes(deletes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Target files to delete, each delete checked against the source of now.

    A path that is a source file again deletes nothing.  Below any other path the
    target files the source does not have are deleted: all of them when the path
    is gone, only the stale ones when it is a folder again.
    """
    gone = deletes.select("path").distinct().join(source.select("path"), "path", "left_anti")
    below = (
        target.select("path", F.explode(paths.ancestors(F.col("path"))).alias("above"))
        .join(gone.select(F.col("path").alias("above")), "above", "left_semi")
        .select("path")
        .distinct()
    )
    return below.join(source.select("path"), "path", "left_anti")


def partition_data_status(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files and bytes in the folder of each partition; hidden files are not counted."""
    folder = paths.parent_of(F.col("path"))
    name = F.substring_index("path", "/", -1)
    totals = (
        manifest.withColumn("folder", folder)
        .groupBy("folder")
        .agg(
            F.count_if(~name.startswith(".")).alias("files"),
            F.sum(F.when(~name.startswith("."), F.col("size")).otherwise(F.lit(0))).alias("bytes"),
        )
    )
    keyed = parts.withColumn("folder", paths.path_of(F.col("location")))
    return keyed.join(totals.withColumn("there", F.lit(True)), "folder", "left").select(
        *parts.columns,
        F.coalesce("there", F.lit(False)).alias("exists"),
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )


def rewrite_location(
    df: DataFrame,
    mappings: Sequence[tuple[str, str]] = (),
    default_fs: str | None = None,
    source: str | None = None,
    target: str | None = None,
    column: str = "location",
) -> DataFrame:
    """Where a location lies on the target site, with a flag for locations no rule covers.

    In order: the first mapping whose name is the authority (with or without a
    port), the default file system, the cluster name replaced as a whole word.
    The rules are configuration, so they become one CASE expression.
    """
    c = F.col(column)
    has_scheme = c.rlike("^[^/]+?://")
    scheme = F.regexp_extract(c, "^([^/]+?)://", 1)
    authority = F.regexp_extract(c, "^[^/]+?://([^/]*)", 1)
    rest = F.regexp_extract(c, "^[^/]+?://[^/]*(.*)$", 1)
    low = F.lower(authority)
    fs = (default_fs or "").strip().rstrip("/") or None

    with_word = authority
    in_path = c
    if source and target:
        quoted = "\\Q" + source + "\\E"
        safe = target.replace("\\", "\\\\").replace("$", "\\$")
        with_word = F.regexp_replace(authority, rf"(?i)\b{quoted}\b", safe)
        in_path = F.regexp_replace(c, f"(?i)/{quoted}(?=/|$)", "/" + safe)
    bare = in_path
    if fs:
        bare = F.concat(F.lit(fs), F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c)))

    fallback = F.concat(scheme, F.lit("://"), with_word, rest)
    if fs:
        full = F.lit(fs) if "://" in fs else F.concat(scheme, F.lit("://" + fs))
        root = F.regexp_extract(full, "^([^/]+?://[^/]*)", 1)
        fallback = F.concat(root, rest)
    mapped = None
    for name, to in mappings:
        hit = (low == name.lower()) | low.startswith(name.lower() + ":")
        value = F.concat(F.lit(to.removesuffix("/")), rest) if "://" in to else F.concat(
            scheme, F.lit("://" + to), rest
        )
        mapped = F.when(hit, value) if mapped is None else mapped.when(hit, value)
    by_rule = fallback if mapped is None else mapped.otherwise(fallback)
    no_hit = F.lit(True)
    for name, _ in mappings:
        no_hit = no_hit & ~((low == name.lower()) | low.startswith(name.lower() + ":"))
    whole = has_scheme & (authority != "")
    unmapped = whole & no_hit & F.lit(fs is None) & (with_word == authority)
    return df.select(
        "*",
        F.when(whole, by_rule).otherwise(bare).alias("target_location"),
        F.coalesce(unmapped, F.lit(False)).alias("unmapped"),
    )


def parse_mappings(text: str | None) -> list[tuple[str, str]]:
    """``a=b,c->d;...`` as (from, to) pairs; incomplete ones are left out."""
    pairs = []
    for part in (text or "").replace(";", ",").split(","):
        left, _, right = part.partition("->" if "->" in part else "=")
        if left.strip() and right.strip():
            pairs.append((left.strip(), right.strip()))
    return pairs

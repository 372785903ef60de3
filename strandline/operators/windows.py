"""Rankings, pages, gaps and flags along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import first_per_key, neighbour, numbered, running
from strandline.session import block_of


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key; a missing order value is the oldest."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def batch_position(df: DataFrame, by: Sequence[str], seq: str, value: str) -> DataFrame:
    """Greatest sequence number of a batch and the value (lag) reported with it."""
    return df.groupBy(*by).agg(F.max(seq).alias(f"max_{seq}"), F.max_by(value, seq).alias(value))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of an order; past the end gives fewer or none."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def limit_with_flag(df: DataFrame, n: int, name: str = "truncated") -> DataFrame:
    """At most ``n`` rows, each with a flag telling that there were more.

    ``n + 1`` rows are taken, whichever the scan gives first; the spare one only
    sets the flag.
    """
    taken = df.limit(n + 1)
    whole = Window.partitionBy(F.lit(0))
    counted = taken.select(
        "*",
        (F.count(F.lit(1)).over(whole) > n).alias(name),
        F.row_number().over(whole.orderBy(F.monotonically_increasing_id())).alias("__rn"),
    )
    return counted.filter(F.col("__rn") <= n).drop("__rn")


def sort_listing(df: DataFrame, by: str = "name", ascending: bool = True) -> DataFrame:
    """Folders before files; the direction applies inside the two groups."""
    key = F.lower(by) if by == "name" else F.col(by)
    return df.orderBy((F.col("kind") == "DIRECTORY").desc(), key.asc() if ascending else key.desc())


def least_loaded(members: DataFrame) -> DataFrame:
    """Online member with the least load per cluster, the first by name on a tie."""
    live = members.filter((F.lower("status") == "online") & F.col("cluster_id").isNotNull())
    pick = F.min(F.struct("load", "agent_id"))
    return live.groupBy("cluster_id").agg(pick.alias("m")).select("cluster_id", "m.agent_id", "m.load")


def affinity_pick(keys: DataFrame, members: DataFrame, key: str, cluster: str, hash_of: Column | None = None) -> DataFrame:
    """A stable member per key: members of the cluster in order, index = hash(key) mod n.

    ``members`` are (cluster, agent_id, agent_no) with a unique number that sets the
    order, so the index comes from a blocked count.  The hash is Spark's Murmur3
    unless another is given.
    """
    ranked = numbered(members, [cluster], ["agent_no"], block_of(F.col("agent_no")), "rank")
    ranked = ranked.select(cluster, "agent_id", (F.col("rank") - 1).alias("slot"))
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    h = F.hash(key) if hash_of is None else hash_of
    slotted = keys.join(sizes, cluster, "left").withColumn("slot", F.pmod(h.cast("long"), F.col("n")))
    return slotted.join(ranked, [cluster, "slot"], "left").select(key, cluster, "agent_id")


def expired(df: DataFrame, states: Sequence[str], before_s: int, n: int, time: str = "updated_s") -> DataFrame:
    """The ``n`` oldest rows in a terminal state from before a moment."""
    return df.filter(F.col("status").isin(*states) & (F.col(time) < before_s)).orderBy(time).limit(n)


def purge(df: DataFrame, states: Sequence[str], before_s: int, time: str = "updated_s") -> DataFrame:
    """What is left when every expired row is gone."""
    old = F.col("status").isin(*states) & (F.col(time) < before_s)
    return df.filter(~F.coalesce(old, F.lit(False)))


def due_jobs(df: DataFrame, scheduled: Column, next_run: str, now_s: int) -> DataFrame:
    return df.filter(scheduled & F.col(next_run).isNotNull() & (F.col(next_run) <= now_s))


def committable_offsets(batches: DataFrame, key: str = "part") -> DataFrame:
    """Offset to commit per partition: one past the unbroken run of settled batches.

    The first unsettled batch ends the run, so two aggregates are enough and no
    window over a partition is needed.
    """
    broken = batches.filter(~F.col("settled")).groupBy(key).agg(F.min("seq").alias("first_open"))
    settled = batches.filter(F.col("settled")).join(broken, key, "left")
    run = settled.filter(F.col("first_open").isNull() | (F.col("seq") < F.col("first_open")))
    return run.groupBy(key).agg((F.max("max_offset") + 1).alias("commit_offset"))


def sequence_gaps(batches: DataFrame, block: Column, key: str = "part") -> DataFrame:
    """Whether each batch continues the one before it; the first of a partition always does."""
    out = neighbour(batches, [key], ["seq"], block, {"accepted": F.col("max_offset")})
    fits = F.col("accepted").isNull() | F.col("prev_max").isNull() | (F.col("prev_max") == F.col("accepted"))
    return out.withColumn("in_sequence", fits)


def log_gap(events: DataFrame, last_id: int, current_id: int | None = None) -> DataFrame:
    """State of a change log after a read position: OK, GAP or RESET."""
    ahead = events.agg(
        F.min(F.when(F.col("event_id") > last_id, F.col("event_id"))).alias("first_available"),
        F.coalesce(F.lit(current_id).cast("long"), F.max("event_id")).alias("current_id"),
    )
    state = (
        F.when(F.lit(last_id > 0) & (F.col("first_available") > last_id + 1), F.lit("GAP"))
        .when(
            F.lit(last_id > 0) & F.col("first_available").isNull() & (F.col("current_id") < last_id), F.lit("RESET")
        )
        .otherwise(F.lit("OK"))
    )
    return ahead.select("first_available", "current_id", state.alias("state"))


def id_gaps(events: DataFrame, block: Column) -> DataFrame:
    """Missing stretches of an event log: (event_id, next_id) with ids absent between them."""
    out = neighbour(events, [], ["event_id"], block, {"next_id": F.col("event_id")}, following=True)
    return out.filter(F.col("next_id") - F.col("event_id") > 1).select("event_id", "next_id")


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, ratio: Column, high: float, low: float) -> DataFrame:
    """On at or above ``high``, off at or below ``low``, otherwise as before (off at first)."""
    signal = F.when(ratio >= high, F.lit(True)).when(ratio <= low, F.lit(False))
    out = running(df, keys, order, block, {"saturated": ("last", signal)})
    return out.withColumn("saturated", F.coalesce("saturated", F.lit(False)))


def prune_runs(runs: DataFrame, limits: DataFrame, block: Column) -> DataFrame:
    """The newest N runs of each job; a job without a limit, or with N <= 0, keeps all."""
    ranked = numbered(runs, ["job_id"], ["run_number"], block, "__age", descending=True)
    keep = F.coalesce(F.col("keep_runs"), F.lit(0))
    return (
        ranked.join(limits, "job_id", "left").filter((keep <= 0) | (F.col("__age") <= keep)).select(*runs.columns)
    )


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows strictly after a saved key."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def keyset_progress(df: DataFrame, key: str, after) -> DataFrame:
    """Rows in all and rows already passed."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(key) <= F.lit(after)).alias("skipped"))

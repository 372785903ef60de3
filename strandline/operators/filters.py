"""Row filters and per-row checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import events as ev
from strandline.functions import names

# Ordering policies of leaf and parent queues.
LEAF_POLICIES = ("fifo", "fair")
PARENT_POLICIES = ("utilization", "priority-utilization")


def any_contains(columns: Sequence[str], text: str) -> Column:
    """Any of the columns contains the text, ignoring case."""
    needle = text.lower()
    return reduce(or_, [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns])


def search_any(df: DataFrame, columns: Sequence[str], text: str, like: bool = False) -> DataFrame:
    """Rows with the text in one of the columns.

    ``like=True`` reads ``%`` and ``_`` in the text as wildcards, as a LIKE pattern
    built from user text does.
    """
    if not text.strip():
        return df
    if not like:
        return df.filter(any_contains(columns, text))
    pattern = f"%{text.lower()}%"
    return df.filter(reduce(or_, [F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in columns]))


def search_row(df: DataFrame, text: str) -> DataFrame:
    """Rows where any cell, as text, contains the needle; empty cells are skipped."""
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.filter(F.exists(cells, lambda x: F.coalesce(x.contains(text.lower()), F.lit(False))))


def visible_saved(df: DataFrame, user: str, newest: str) -> DataFrame:
    """Own and shared items, newest first."""
    return df.filter((F.col("username") == user) | F.col("shared")).orderBy(F.desc(newest))


def status_filter(df: DataFrame, status: str | None) -> DataFrame:
    return df.filter(names.status_is(F.col("status"), status, F.col("sync_mode")))


def allowed_groups(df: DataFrame, pattern: str = names.EXCLUDED_GROUPS) -> DataFrame:
    """Consumer groups that are carried over, trimmed."""
    return df.filter(~names.excluded_group(F.col("group_id"), pattern)).withColumn("group_id", F.trim("group_id"))


def excluded_groups(df: DataFrame, pattern: str = names.EXCLUDED_GROUPS) -> DataFrame:
    """The distinct groups that are left out."""
    return df.filter(names.excluded_group(F.col("group_id"), pattern)).select(
        F.trim("group_id").alias("group_id")
    ).distinct()


def evaluate_table(df: DataFrame) -> DataFrame:
    """Support flag and reason from the ``parameters`` map."""
    return df.withColumn("s", ev.table_support(F.col("parameters"))).select(*df.columns, "s.supported", "s.reason")


def included_events(df: DataFrame, db: str, pattern: str) -> DataFrame:
    """Events of one database and the filtered tables; a rename counts under both names."""
    same_db = F.col("db_name").isNull() | (F.lower("db_name") == db.lower())
    blank = F.col("table_name").isNull() | (F.trim("table_name") == "")
    renamed = (
        (F.upper("event_type") == "ALTER_TABLE")
        & F.col("renamed_to").isNotNull()
        & (F.lower("renamed_to") != F.lower("table_name"))
        & names.match_table(F.col("renamed_to"), pattern)
    )
    return df.filter(same_db & (blank | names.match_table(F.col("table_name"), pattern) | F.coalesce(renamed, F.lit(False))))


def tag_event_support(df: DataFrame) -> DataFrame:
    support = F.when(names.handled_event(F.col("event_type")), "HANDLED").otherwise("SKIPPED_UNSUPPORTED")
    return df.withColumn("support", support)


def validate_capacity(df: DataFrame) -> DataFrame:
    """One row per broken range rule of each undeleted (path, label)."""
    c, m = F.col("capacity"), F.col("max_capacity")
    errors = F.array_compact(
        F.array(
            F.when((c < 0) | (c > 100), F.lit("CAPACITY_RANGE")),
            F.when((m < 0) | (m > 100), F.lit("MAX_RANGE")),
            F.when(m + 1e-9 < c, F.lit("MAX_BELOW_CAPACITY")),
        )
    )
    return df.filter(F.col("action") != "delete").select("*", F.explode(errors).alias("error"))


def with_elasticity(df: DataFrame) -> DataFrame:
    c, m = F.col("capacity"), F.col("max_capacity")
    return df.select("*", (m > c).alias("elastic"), F.when(c > 0, F.round(m / c, 2)).otherwise(1.0).alias("elasticity"))


def valid_transition(before: Column, after: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """Whether a status change is allowed; staying is always allowed."""
    moves = [F.when(before == state, after.isin(*to) if to else F.lit(False)) for state, to in allowed.items()]
    return F.when(after.isNull(), False).when(before == after, True).otherwise(F.coalesce(*moves, F.lit(False)))


def validate_policy(df: DataFrame) -> DataFrame:
    """Queues whose ordering policy does not fit: leaf and parent queues have their own."""
    parents = df.select(F.col("parent_path").alias("path")).distinct().withColumn("is_parent", F.lit(True))
    checked = df.filter((F.col("action") != "delete") & (F.trim("policy") != "")).join(parents, "path", "left")
    policy = F.lower("policy")
    ok = F.when(F.coalesce("is_parent", F.lit(False)), policy.isin(*PARENT_POLICIES)).otherwise(
        policy.isin(*LEAF_POLICIES)
    )
    return checked.filter(~ok).select(
        *[c for c in df.columns if c != "policy"], policy.alias("policy"), F.lit("POLICY_NOT_ALLOWED").alias("error")
    )


def filter_members(df: DataFrame, cluster: str | None, status: str | None, text: str | None) -> DataFrame:
    """Members by cluster (a missing one is ``-``), online or not, and text in id or address."""
    out = df
    if cluster is not None:
        out = out.filter(F.coalesce("cluster_id", F.lit("-")) == cluster)
    if status is not None:
        online = F.coalesce(F.lower("status") == "online", F.lit(False))
        out = out.filter(online if status == "online" else ~online)
    return search_any(out, ["agent_id", "address"], text) if text else out

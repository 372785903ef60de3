"""Keyed streaming aggregates: progress, terminal states, positions, group offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import filters, joins
from strandline.operators.ordered import settled


def progress_deltas(stream: DataFrame, key: str = "job_id") -> DataFrame:
    """Bytes and files moved per job so far."""
    return stream.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def first_terminal(events: DataFrame, key: str, terminal: Sequence[str], seq: str = "seq") -> DataFrame:
    """First terminal status of each object; later ones do not replace it."""
    done = events.filter(F.col("status").isin(*terminal))
    return done.groupBy(key).agg(F.min(F.struct(seq, "status")).alias("f")).select(key, f"f.{seq}", "f.status")


def monotonic_position(stream: DataFrame, key: str, position: str) -> DataFrame:
    """Greatest position reported for each key."""
    return stream.groupBy(key).agg(F.max(position).alias(position))


def sync_offsets(groups: DataFrame, exact: DataFrame, last: DataFrame, target_log: DataFrame, current: DataFrame,
                 live: DataFrame, block_ms: int = joins.TIME_BLOCK_MS) -> DataFrame:
    """One pass of carrying group offsets over: allowed groups, time of the offset, target offset, guard."""
    translated = joins.translate_offsets(filters.allowed_groups(groups), exact, last).filter(F.col("ts_ms") > 0)
    found = joins.offsets_for_times(settled(translated), target_log, block_ms).filter(F.col("target_offset").isNotNull())
    return joins.apply_offsets(current, found.select("group_id", "topic", "part", "target_offset"), live)

"""Metastore change events: ordered application, retries, dead letters, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators.ordered import running
from strandline.operators.windows import latest_per_key
from strandline.session import block_of

#: Renames in a row of one table that are followed; beyond it the query fails, nothing is left out.
LONGEST_LINEAGE = 1_000_000

CATALOG_SCHEMA = "table_name string, part_name string, event_id long, payload long"


def object_changes(events: DataFrame) -> DataFrame:
    """What each handled event does to which object.

    Rows (table_name, part_name, change, moved_to, event_id, payload); a partition
    name of '' stands for the table itself.  A rename is a delete of the old name,
    which says where the table moved to, and an upsert of the new one.
    """
    kind = F.upper("event_type")
    renamed = (kind == "ALTER_TABLE") & F.col("renamed_to").isNotNull() & (
        F.lower("renamed_to") != F.lower("table_name")
    )
    nowhere = F.lit(None).cast("string")
    change = lambda table, part, what, to=nowhere: F.struct(
        table.alias("table_name"), part.alias("part_name"), F.lit(what).alias("change"), to.alias("moved_to")
    )
    table, whole, part = F.col("table_name"), F.lit(""), F.coalesce("part_name", F.lit(""))
    new = F.col("renamed_to")
    effects = (
        F.when(renamed, F.array(change(table, whole, "delete", new), change(new, whole, "upsert")))
        .when(kind.isin("CREATE_TABLE", "ALTER_TABLE"), F.array(change(table, whole, "upsert")))
        .when(kind == "DROP_TABLE", F.array(change(table, whole, "delete")))
        .when(kind == "DROP_PARTITION", F.array(change(table, part, "delete")))
        .otherwise(F.array(change(table, part, "upsert")))
    )
    return (
        events.filter(names.handled_event(F.col("event_type")))
        .select("event_id", "payload", F.explode(effects).alias("e"))
        .select("e.*", "event_id", "payload")
    )


def _first_stop(asked: DataFrame, stops: DataFrame) -> DataFrame:
    """``stop`` (event_id, moved_to): the first drop or rename of a table after ``at``; a forward as-of join."""
    sided = asked.withColumn("side", F.lit(0)).unionByName(stops.withColumn("side", F.lit(1)), allowMissingColumns=True)
    found = running(
        sided, ["table_name"], ["at", "side"], block_of(F.col("at")), {"next": ("last", F.col("stop"))}, descending=True, inclusive=False
    )
    return found.filter(F.col("side") == 0).select(*asked.columns, F.col("next").alias("stop"))


def table_lineage(ends: DataFrame) -> DataFrame:
    """(event_id, final_name): what a table that a drop or rename ended is called in the end, null if it was dropped.

    A rename is an edge to the next drop or rename of its new name. The edges are followed
    by a recursive query, one step for all lineages at once: as many steps as the
    longest row of renames of one table, whatever the number of tables and events.
    """
    spark = ends.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    stops = ends.select("table_name", F.col("event_id").alias("at"), F.struct("event_id", "moved_to").alias("stop"))
    renamed = ends.filter(F.col("moved_to").isNotNull()).select(F.col("moved_to").alias("table_name"), F.col("event_id").alias("at"))
    edges = _first_stop(renamed, stops).select(F.col("at").alias("id"), F.col("table_name").alias("name"), F.col("stop.event_id").alias("next_id"))
    dropped = ends.filter(F.col("moved_to").isNull()).select(
        F.col("event_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("next_id")
    )
    return spark.sql(
        f"""WITH RECURSIVE walk(event_id, name, next_id) MAX RECURSION LEVEL {LONGEST_LINEAGE} AS (
              SELECT id, name, next_id FROM {{edges}}
              UNION ALL SELECT w.event_id, e.name, e.next_id FROM walk w JOIN {{edges}} e ON w.next_id = e.id)
            SELECT event_id, name AS final_name FROM walk WHERE next_id IS NULL""",
        edges=edges.unionByName(dropped),
    )


def _follow_tables(partitions: DataFrame, ends: DataFrame) -> DataFrame:
    """Partition changes under the name their table has in the end; those of dropped tables are gone."""
    stops = ends.select("table_name", F.col("event_id").alias("at"), F.struct("event_id", "moved_to").alias("stop"))
    asked = _first_stop(partitions.withColumn("at", F.col("event_id")), stops)
    lineage = table_lineage(ends).withColumnRenamed("event_id", "end_id")
    ended = asked.join(lineage, F.col("stop.event_id") == F.col("end_id"), "left")
    name = F.when(F.col("stop").isNull(), F.col("table_name")).otherwise(F.col("final_name"))
    return ended.withColumn("table_name", name).filter(F.col("table_name").isNotNull()).select(*partitions.columns)


def catalog_state(changes: DataFrame) -> DataFrame:
    """Tables and partitions there are after a log of changes, folded by event id.

    Only the last change of an object counts.  Partitions go with a dropped table,
    unless they were changed after the drop, and move with a renamed one. Nothing runs
    while the plan is built.
    """
    kept = ["table_name", "part_name", "event_id", "payload", "change"]
    whole = F.col("part_name") == ""
    tables = latest_per_key(changes.filter(whole).select(*kept), ["table_name"], ["event_id"])
    followed = _follow_tables(changes.filter(~whole).select(*kept), changes.filter(whole & (F.col("change") == "delete")))
    every = tables.unionByName(latest_per_key(followed, ["table_name", "part_name"], ["event_id"]))
    return every.filter(F.col("change") == "upsert").select("table_name", "part_name", "event_id", "payload")


def apply_catalog_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """State after one more batch of events.

    Events at or below an object's own event id have been applied before and
    change nothing, so a batch may be repeated.
    """
    known = state.withColumn("change", F.lit("upsert")).withColumn("moved_to", F.lit(None).cast("string"))
    changes = object_changes(events)
    return catalog_state(changes.unionByName(known.select(*changes.columns))).select(*state.columns)


def split_dead_letters(events: DataFrame, attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Outcome of every event of a batch: APPLIED, DLQ_ISOLATED, RETRY or PENDING.

    ``events`` has (job_id, event_id, ok), ``attempts`` (job_id, event_id, attempts).
    The first failing event that may still be tried stops its job: what comes
    after it is not applied in this batch.
    """
    tried = events.join(attempts, ["job_id", "event_id"], "left").withColumn(
        "attempts", F.when(F.col("ok"), F.lit(0)).otherwise(F.coalesce("attempts", F.lit(0)) + 1)
    )
    retry = ~F.col("ok") & (F.col("attempts") < max_attempts)
    stops = tried.filter(retry).groupBy("job_id").agg(F.min("event_id").alias("stop"))
    outcome = (
        F.when(F.col("event_id") > F.col("stop"), F.lit("PENDING"))
        .when(F.col("event_id") == F.col("stop"), F.lit("RETRY"))
        .when(F.col("ok"), F.lit("APPLIED"))
        .otherwise(F.lit("DLQ_ISOLATED"))
    )
    return tried.join(stops, "job_id", "left").withColumn("outcome", outcome).drop("stop")


def next_attempts(outcomes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempt counters after a batch: applied and isolated events are forgotten."""
    counted = outcomes.filter(F.col("outcome") == "RETRY").select("job_id", "event_id", "attempts")
    settled = outcomes.filter(F.col("outcome") != "PENDING").select("job_id", "event_id")
    return counted.unionByName(attempts.join(settled, ["job_id", "event_id"], "left_anti"))


def dead_letters(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Dead letters after a batch, one per (job, event)."""
    new = outcomes.filter(F.col("outcome") == "DLQ_ISOLATED").select(
        "job_id", "event_id", F.lit("ISOLATED").alias("status")
    )
    return new.unionByName(known.select(*new.columns).join(new, ["job_id", "event_id"], "left_anti"))


def _mark(dlq: DataFrame, chosen: DataFrame, status: str) -> DataFrame:
    marks = chosen.select("job_id", "event_id").distinct().withColumn("__chosen", F.lit(True))
    shown = F.when(F.col("__chosen"), F.lit(status)).otherwise(F.col("status"))
    return dlq.join(marks, ["job_id", "event_id"], "left").withColumn("status", shown).drop("__chosen")


def replay(dlq: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dead letters with the chosen ones marked REPLAYED."""
    return _mark(dlq, chosen, "REPLAYED")


def skip(dlq: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dead letters with the chosen ones marked IGNORED."""
    return _mark(dlq, chosen, "IGNORED")


def replay_positions(positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Read position of every job rolled back to just before its first replayed event."""
    back = chosen.groupBy("job_id").agg((F.min("event_id") - 1).alias("back_to"))
    moved = F.least(F.col("event_id"), F.coalesce("back_to", "event_id"))
    return positions.join(back, "job_id", "left").select("job_id", moved.alias("event_id"))


def event_lag(log: DataFrame, positions: DataFrame, by: str) -> DataFrame:
    """Events between the end of a log and the committed position of each job reading it."""
    ends = log.groupBy(by).agg(F.max("event_id").alias("current_id"))
    lag = F.greatest(F.lit(0), F.coalesce("current_id", F.lit(0)) - F.col("event_id"))
    return positions.join(ends, by, "left").select("job_id", by, lag.alias("lag"))

"""Progress of parents from the totals of their subjobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import display
from strandline.operators.aggregates import aggregate_subjobs


def with_progress(parents: DataFrame, jobs: DataFrame, now_s: int) -> DataFrame:
    """Percent done, average MB per second and expected end of each parent.

    The subjobs are summed per parent first, so the join moves one row per parent.
    """
    totals = aggregate_subjobs(jobs).withColumnRenamed("parent_id", "id")
    joined = parents.join(totals, "id", "left")
    ended = (F.col("active") == 0) & F.col("last_completed_s").isNotNull()
    end = F.when(ended, F.col("last_completed_s")).otherwise(F.lit(now_s))
    elapsed = F.greatest(F.lit(1), end - F.col("first_started_s"))
    out = joined.select(
        *parents.columns,
        F.coalesce("jobs", F.lit(0)).alias("jobs"),
        F.coalesce(display.progress_percent(F.col("copied_bytes"), F.col("total_bytes")), F.lit(0.0)).alias("progress"),
        display.speed_mb_s(F.col("copied_bytes"), elapsed).alias("mb_s"),
        F.col("total_bytes"), F.col("copied_bytes"),
        F.coalesce(ended, F.lit(False)).alias("ended"), F.col("last_completed_s"),
    )
    eta = F.when(F.col("ended") & (F.col("progress") >= 100), F.col("last_completed_s")).otherwise(
        display.eta_s(F.col("copied_bytes"), F.col("total_bytes"), F.col("mb_s"), F.lit(now_s))
    )
    return out.withColumn("eta_s", eta).drop("ended", "last_completed_s")

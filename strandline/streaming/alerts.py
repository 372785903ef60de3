"""Rates, ratios, quantiles, sustained conditions, liveness and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import neighbour, running, settled

# Seconds of silence.
SUSPECT_S = 30
OFFLINE_S = 90
EVICT_S = 24 * 3600


def increases(samples: DataFrame, series: Sequence[str], value: Column, block: Column, order: str = "seq") -> DataFrame:
    """Growth of a counter since its sample before: all of it after a restart, 0 for the first."""
    out = neighbour(samples, series, [order], block, {"__before": value})
    grown = F.when(F.col("__before").isNull(), F.lit(0)).when(value < F.col("__before"), value).otherwise(
        value - F.col("__before")
    )
    return out.withColumn("increase", grown).drop("__before")


def sliding_sums(df: DataFrame, by: Sequence[str], ts_s: Column, sums: dict[str, Column], window_s: int, slide_s: int) -> DataFrame:
    """Sums over sliding windows (by.., window_start_s).

    Rows are first summed per slide, so that only those sums are multiplied into
    the ``window / slide`` windows they lie in.  The slide must divide the window.
    """
    slide = (F.floor(ts_s / slide_s) * slide_s).cast("long")
    per_slide = df.groupBy(*by, slide.alias("__slide")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(window_s // slide_s - 1)), lambda i: F.col("__slide") - i * F.lit(slide_s)
    )
    spread = per_slide.withColumn("window_start_s", F.explode(starts))
    return spread.groupBy(*by, "window_start_s").agg(*[F.sum(n).alias(n) for n in sums])


def counter_rate(
    samples: DataFrame, series: Sequence[str], by: Sequence[str], value: Column, ts_s: Column, block: Column,
    window_s: int, slide_s: int,
) -> DataFrame:
    """Growth per second of counters over sliding windows, summed over ``by``.

    The growth inside a window is divided by its length; it is not extrapolated to
    the edges of the window.
    """
    grown = increases(samples, series, value, block)
    sums = sliding_sums(grown, by, ts_s, {"increase": F.col("increase")}, window_s, slide_s)
    return sums.select(*by, "window_start_s", (F.col("increase") / window_s).alias("rate"))


def spike_alert(rates: DataFrame, threshold: float) -> DataFrame:
    """Windows whose rate is above a threshold."""
    return rates.filter(F.col("rate") > threshold)


def windowed_ratio(stream: DataFrame, time: str, by: Sequence[str], part: Column, window: str, slide: str, delay: str | None = None) -> DataFrame:
    """Share of rows of a kind per key and sliding window of a stream.

    Without ``delay`` every row counts, however late; the result is read with
    ``keyed_result`` and does not depend on how the input is cut into micro-batches.
    With it a window is given once it is closed, its state goes, and rows that come
    later than that are dropped.
    """
    timed = stream if delay is None else stream.withWatermark(time, delay)
    return (
        timed.groupBy(*by, F.window(time, window, slide))
        .agg(F.count_if(part).alias("hits"), F.count(F.lit(1)).alias("rows"))
    )


def ratio_alert(ratios: DataFrame, threshold: float) -> DataFrame:
    return ratios.filter(F.col("hits") / F.col("rows") > threshold)


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str]) -> DataFrame:
    """Quantile from cumulative buckets (by.., le, n), linear inside the bucket.

    There is one row per bound and key, so a key's window is as long as the list
    of bounds.  Above the last finite bound that bound is given.
    """
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    window = Window.partitionBy(*by).orderBy("bound")
    whole = Window.partitionBy(*by)
    placed = buckets.select(*by, bound.alias("bound"), "n").select(
        *by, "bound", "n",
        F.lag("bound", 1, 0.0).over(window).alias("low"), F.lag("n", 1, 0).over(window).alias("below"),
        (F.max("n").over(whole) * q).alias("rank"),
    )
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (F.col("rank") - F.col("below")) / F.nullif(
        F.col("n") - F.col("below"), F.lit(0)
    )
    value = F.when(F.col("bound") == float("inf"), F.col("low")).otherwise(F.coalesce(inside, F.col("bound")))
    hit = placed.filter((F.col("n") >= F.col("rank")) & (F.col("rank") > 0))
    return hit.groupBy(*by).agg(F.min_by(value, "bound").alias("quantile"))


def sustained(df: DataFrame, keys: Sequence[str], order: str, ts_s: Column, condition: Column, hold_s: int, block: Column) -> DataFrame:
    """Rows at which a condition has held without a break for ``hold_s`` seconds."""
    base = df.withColumn("__on", F.coalesce(condition, F.lit(False))).withColumn("__ts", ts_s)
    out = neighbour(base, keys, [order], block, {"__was": F.col("__on")})
    out = settled(out)
    begins = F.when(F.col("__on") & ~F.coalesce("__was", F.lit(False)), F.col("__ts"))
    out = running(out, keys, [order], block, {"since_s": ("last", begins)})
    fires = F.col("__on") & (F.col("__ts") - F.col("since_s") >= hold_s)
    return out.filter(fires).select(*df.columns, "since_s")


def starvation(df: DataFrame, ts_s: Column, window_s: int, workers: Column, queued: Column) -> DataFrame:
    """Windows without a worker although work is queued; both are counted in one pass."""
    start = (F.floor(ts_s / window_s) * window_s).cast("long")
    per_window = df.groupBy(start.alias("window_start_s")).agg(
        F.count_if(workers).alias("workers"), F.count_if(queued).alias("queued")
    )
    return per_window.filter((F.col("workers") == 0) & (F.col("queued") > 0))


def last_seen(heartbeats: DataFrame, key: str, ts_s: str = "ts_s") -> DataFrame:
    """Last heartbeat of every member; a streaming aggregate as well as a batch one."""
    return heartbeats.groupBy(key).agg(F.max(ts_s).alias("seen_s"))


def liveness(seen: DataFrame, now_s: int, suspect_s: int = SUSPECT_S, offline_s: int = OFFLINE_S, evict_s: int = EVICT_S) -> DataFrame:
    """ONLINE, SUSPECT or OFFLINE by silence; members silent for too long are left out."""
    silent = F.lit(now_s) - F.col("seen_s")
    status = F.when(silent >= offline_s, "OFFLINE").when(silent >= suspect_s, "SUSPECT").otherwise("ONLINE")
    return seen.filter(silent < evict_s).withColumn("status", status)


def idle_sessions(seen: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """Members whose last activity is older than the time to live."""
    return seen.filter(F.col("seen_s") < now_s - ttl_s)


def activity_sessions(events: DataFrame, key: str, order: str, ts_s: str, ttl_s: int, block: Column) -> DataFrame:
    """Sessions split where a member was idle for ``ttl_s`` seconds or more: (key, session_no, start, end, rows)."""
    out = neighbour(events, [key], [order], block, {"__before": F.col(ts_s)})
    out = settled(out)
    begins = F.when(F.col("__before").isNull() | (F.col(ts_s) - F.col("__before") >= ttl_s), 1).otherwise(0)
    out = running(out, [key], [order], block, {"session_no": ("sum", begins)})
    return out.groupBy(key, "session_no").agg(
        F.min(ts_s).alias("start_s"), F.max(ts_s).alias("end_s"), F.count(F.lit(1)).alias("events")
    )

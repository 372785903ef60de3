"""Query templates offered to users, and the function vocabulary they may use."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.clock import epoch_s
from strandline.operators.ordered import neighbour, running


def in_year(ts: str, year: int) -> Column:
    """Range filter on the bare column, so that it reaches the scan and prunes partitions."""
    start = F.lit(datetime.date(year, 1, 1)).cast("timestamp_ntz")
    end = F.lit(datetime.date(year + 1, 1, 1)).cast("timestamp_ntz")
    return (F.col(ts) >= start) & (F.col(ts) < end)


def top_spenders(customer: DataFrame, orders: DataFrame, n: int = 100) -> DataFrame:
    """Customers by money spent: orders are summed per customer before the join."""
    spent = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("orders"))
    return (
        customer.join(spent, F.col("c_custkey") == F.col("o_custkey"))
        .select("c_custkey", "c_name", F.round("spent", 2).alias("total_spent"), "orders")
        .orderBy(F.desc("total_spent"), "c_custkey")
        .limit(n)
    )


def top_customers(customer: DataFrame, min_balance: float, n: int) -> DataFrame:
    """Customers above a balance, richest first."""
    return (
        customer.filter(F.col("c_acctbal") > min_balance)
        .select("c_custkey", "c_name", "c_acctbal")
        .orderBy(F.desc("c_acctbal"), "c_custkey")
        .limit(n)
    )


def top_customers_year(customer: DataFrame, orders: DataFrame, year: int, n: int = 10) -> DataFrame:
    return top_spenders(customer, orders.filter(in_year("o_orderdate", year)), n)


def orders_by_status(orders: DataFrame, year: int) -> DataFrame:
    return (
        orders.filter(in_year("o_orderdate", year))
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(F.sum("o_totalprice"), 2).alias("revenue"),
            F.round(F.avg("o_totalprice"), 2).alias("average"),
        )
    )


def daily_users(events: DataFrame, now: datetime.date, days: int = 30) -> DataFrame:
    """Distinct users and mean active span per day and event type, newest day first.

    A user's span is the time between the first and the last event of the day.
    """
    start = F.lit(now - datetime.timedelta(days=days)).cast("timestamp_ntz")
    day = F.to_date("ts")
    spans = (
        events.filter(F.col("ts") >= start)
        .groupBy(day.alias("day"), "event_type", "user_id")
        .agg((F.max(epoch_s(F.col("ts"))) - F.min(epoch_s(F.col("ts")))).alias("span_s"))
    )
    return (
        spans.groupBy("day", "event_type")
        .agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("span_s"), 2).alias("span_s"))
        .orderBy(F.desc("day"), "event_type")
    )


def activity_by_type(events: DataFrame, approx: bool = False) -> DataFrame:
    """Events and distinct users per event type; ``approx`` counts users with HyperLogLog++ (1 % standard error)."""
    users = F.approx_count_distinct("user_id", 0.01) if approx else F.countDistinct("user_id")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), users.alias("users"))


#: Base-two logarithm of the registers of a user sketch: 16,384, a standard error of 0.8 %.
SKETCH_BITS = 14


def user_sketches(events: DataFrame) -> DataFrame:
    """(day, event_type, events, users): a count and a mergeable sketch of the users of each day and type.

    To be stored per day: longer spans are merged from these rows, without the events.
    """
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users")
    )


def merged_users(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Events and estimated distinct users of any grouping of stored sketches."""
    return sketches.groupBy(*by).agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def user_activity(events: DataFrame, n: int = 100) -> DataFrame:
    """Most active users with their last event."""
    return (
        events.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("actions"), F.max(epoch_s(F.col("ts"))).alias("last_seen_s"))
        .orderBy(F.desc("actions"), "user_id")
        .limit(n)
    )


def agg_vocabulary(events: DataFrame) -> DataFrame:
    """APPROX_DISTINCT, ARBITRARY and ARRAY_AGG; the lists hold distinct event types only."""
    kinds = F.array_sort(F.collect_set("event_type"))
    return events.groupBy("user_id").agg(
        F.approx_count_distinct("event_type").alias("kinds_approx"),
        F.any_value("user_id").alias("any_user"),
        F.array_join(kinds, ",").alias("kinds"),
    )


def array_vocabulary(records: DataFrame) -> DataFrame:
    """SPLIT, CARDINALITY, FLATTEN, ZIP and UNNEST over a path column."""
    parts = F.split("path", "/")
    zipped = F.arrays_zip(parts.alias("p"), F.sequence(F.lit(1), F.size(parts)).alias("n"))
    return records.select(
        "doc_id",
        F.size(parts).alias("cardinality"),
        F.size(F.flatten(F.array(parts, parts))).alias("flat"),
        F.explode(zipped).alias("z"),
    ).select("doc_id", "cardinality", "flat", F.col("z.p").alias("piece"), F.col("z.n").alias("position"))


def date_vocabulary(orders: DataFrame) -> DataFrame:
    """DATE_ADD, DATE_DIFF, DATE_FORMAT, DATE_PARSE, DATE_TRUNC, FROM_UNIXTIME, FROM_ISO8601."""
    day = F.to_date("o_orderdate")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey",
        F.date_format(F.date_add(day, 10), "yyyy-MM-dd").alias("plus_10"),
        F.date_diff(F.lit(datetime.date(2002, 1, 1)), day).alias("days_left"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("shown"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"),
        F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("parsed"),
        epoch_s(F.col("o_orderdate")).alias("unix_s"),
        (F.current_date() >= F.lit(datetime.date(2020, 1, 1))).alias("today_is_later"),
    )


def json_vocabulary(events: DataFrame) -> DataFrame:
    """JSON_EXTRACT, JSON_EXTRACT_SCALAR, JSON_PARSE, JSON_SIZE and JSON_ARRAY_CONTAINS."""
    k = F.get_json_object("props", "$.k")
    array = F.concat(F.lit("["), k, F.lit(",7]"))
    return events.select(
        "event_id",
        k.alias("k_text"),
        F.from_json("props", "k BIGINT")["k"].alias("k_number"),
        F.size(F.json_object_keys("props")).alias("fields"),
        F.json_array_length(array).alias("array_len"),
        F.array_contains(F.from_json(array, "array<bigint>"), F.lit(7).cast("long")).alias("has_7"),
    )


def string_vocabulary(pages: DataFrame) -> DataFrame:
    """COALESCE, CONCAT, REGEXP_EXTRACT and REGEXP_LIKE."""
    query = F.nullif(F.regexp_extract("url", r"\?(.*)$", 1), F.lit(""))
    return pages.select(
        "page_id",
        F.coalesce(query, F.lit("none")).alias("query"),
        F.concat(F.lit("<"), F.regexp_extract("url", "^([a-z]+)://", 1), F.lit(">")).alias("scheme"),
        F.col("url").rlike("page=[0-9]+").alias("paged"),
    )


def window_vocabulary(events: DataFrame, block: Column) -> DataFrame:
    """ROW_NUMBER, LAG and LEAD per user along the event number."""
    keys, order = ["user_id"], ["event_id"]
    base = events.select("user_id", "event_id", "event_type")
    wanted = {"rn": ("count", F.lit(1)), "before": ("previous", F.col("event_type"))}
    out = running(base, keys, order, block, wanted)
    return neighbour(out, keys, order, block, {"after": F.col("event_type")}, following=True)


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """ROW_NUMBER kept up to ``n``: only ``n`` rows of a key leave each map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def safe_cast(records: DataFrame) -> DataFrame:
    """CAST, TRY_CAST and TRY on text that may not be a number."""
    n = F.col("hop").try_cast("int")
    return records.select(
        "rec_offset",
        n.alias("hop_no"),
        F.col("rec_offset").cast("string").alias("offset_text"),
        F.round(F.try_divide(F.lit(100), n), 4).alias("share"),
    )

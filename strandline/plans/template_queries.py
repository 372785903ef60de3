"""Registered queries of the user templates, the function vocabulary and the step graph."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from strandline.functions.display import to_display
from strandline.operators.windows import limit_with_flag
from strandline.plans import templates
from strandline.plans.registry import query
from strandline.plans.step_graph import Edge, StepGraph, sql_step, step
from strandline.session import block_of, scratch_path


@query(
    "Q01_high_balance",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
)
def high_balance(t):
    return templates.top_customers(t.customer, 1000.0, 50)


@query(
    "Q02_top_customers_year",
    """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total_spent, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY c_custkey, c_name ORDER BY total_spent DESC, c_custkey LIMIT 10""",
)
def top_customers_year(t):
    return templates.top_customers_year(t.customer, t.orders, 1998)


@query(
    "Q03_orders_by_status",
    """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 2) AS average FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY o_orderstatus""",
)
def orders_by_status(t):
    return templates.orders_by_status(t.orders, 1998)


@query(
    "Q04_top_balance",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
)
def top_balance(t):
    return templates.top_customers(t.customer, 0.0, 20)


@query(
    "Q05_daily_users",
    """WITH s AS (SELECT CAST(ts AS DATE) AS d, event_type, user_id, max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) - min(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) AS span_s
          FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
       SELECT CAST(d AS VARCHAR) AS day, event_type, count(*) AS users, round(avg(span_s), 2) AS span_s FROM s GROUP BY d, event_type""",
)
def daily_users(t):
    out = templates.daily_users(t.events, datetime.date(2024, 2, 9))
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "Q06_activity_by_type",
    "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def activity_by_type(t):
    return templates.activity_by_type(t.events)


def _close(estimates, exact, by):
    """Whether each estimate is within 5 % of the exact number."""
    both = estimates.join(exact.withColumnRenamed("users", "exact"), by)
    return both.withColumn("close", F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")).drop("users", "exact")


@query("Q06_activity_by_type_approx", "SELECT event_type, count(*) AS events, true AS close FROM events GROUP BY event_type")
def activity_by_type_approx(t):
    exact = templates.activity_by_type(t.events).select("event_type", "users")
    return _close(templates.activity_by_type(t.events, approx=True), exact, ["event_type"])


def _stored_sketches(t):
    path = scratch_path(t.spark, "user-sketches")
    templates.user_sketches(t.events).write.partitionBy("day").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "Q06_users_by_day",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS events, true AS close FROM events GROUP BY 1, 2",
)
def users_by_day(t):
    day = F.to_date("ts").cast("string").alias("day")
    exact = t.events.groupBy(day, "event_type").agg(F.countDistinct("user_id").alias("users"))
    stored = _stored_sketches(t).withColumn("day", F.col("day").cast("string"))
    return _close(templates.merged_users(stored, "day", "event_type"), exact, ["day", "event_type"])


@query("Q06_users_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events, true AS close FROM events GROUP BY 1")
def users_by_month(t):
    exact = t.events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct("user_id").alias("users"))
    months = templates.merged_users(_stored_sketches(t), F.date_format("day", "yyyy-MM").alias("month"))
    return _close(months, exact, ["month"])


@query(
    "Q07_agg_vocabulary",
    """SELECT user_id, count(DISTINCT event_type) AS kinds_approx, user_id AS any_user, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id""",
)
def agg_vocabulary(t):
    return templates.agg_vocabulary(t.events)


@query(
    "Q08_array_vocabulary",
    """WITH p AS (SELECT doc_id, string_split(path, '/') AS a FROM paths)
       SELECT doc_id, CAST(len(a) AS INT) AS cardinality, CAST(len(flatten([a, a])) AS INT) AS flat, unnest(a) AS piece, CAST(unnest(range(1, len(a) + 1)) AS INT) AS position FROM p""",
)
def array_vocabulary(t):
    return templates.array_vocabulary(t.paths)


@query(
    "Q09_date_vocabulary",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS plus_10, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS days_left,
       strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d') AS parsed,
       CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS unix_s, true AS today_is_later FROM orders""",
)
def date_vocabulary(t):
    return templates.date_vocabulary(t.orders)


@query(
    "Q10_json_vocabulary",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number, CAST(len(json_keys(props)) AS INT) AS fields, 2 AS array_len, true AS has_7 FROM events""",
)
def json_vocabulary(t):
    return templates.json_vocabulary(t.events)


@query(
    "Q11_string_vocabulary",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '\?(.*)$', 1), ''), 'none') AS query, '<' || regexp_extract(url, '^([a-z]+)://', 1) || '>' AS scheme, regexp_matches(url, 'page=[0-9]+') AS paged FROM pages""",
)
def string_vocabulary(t):
    return templates.string_vocabulary(t.pages)


@query(
    "Q12_window_vocabulary",
    """SELECT user_id, event_id, event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def window_vocabulary(t):
    return templates.window_vocabulary(t.events, block_of(F.col("event_id")))


@query(
    "Q12_ranked_within",
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def ranked_within(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return templates.ranked_within(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(
    "Q13_safe_cast",
    """SELECT rec_offset, try_cast(trim(hop) AS INT) AS hop_no, CAST(rec_offset AS VARCHAR) AS offset_text, round(100.0e0 / nullif(try_cast(trim(hop) AS INT), 0), 4) AS share FROM records""",
)
def safe_cast(t):
    return templates.safe_cast(t.records)


@query(
    "D02_step_graph",
    """WITH s AS (SELECT c_nationkey AS nation, sum(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
       SELECT n_name, round(amount, 2) AS amount FROM s JOIN nation ON nation = n_nationkey WHERE amount > 1000""",
)
def step_graph(t):
    graph = StepGraph(
        [
            step("orders", lambda: t.orders),
            step("customer", lambda: t.customer),
            step("nation", lambda: t.nation),
            step(
                "spent",
                lambda orders, customer: orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
                .join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "spent"),
            ),
            sql_step("amounts", "SELECT c_nationkey AS nation, sum(spent) AS amount FROM {spent} GROUP BY c_nationkey"),
            sql_step("report", "SELECT n_name, round(amount, 2) AS amount FROM {amounts} JOIN {nation} ON nation = n_nationkey WHERE amount > 1000"),
        ],
        [
            Edge("orders", "spent"), Edge("customer", "spent"), Edge("spent", "amounts"),
            Edge("amounts", "report"), Edge("nation", "report"),
        ],
    )
    return graph.run(t.spark)["report"]


@query(
    "D04_display",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS price, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000""",
)
def display(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return limit_with_flag(to_display(rows.orderBy("o_orderkey")), 1000)


@query(
    "D05_capped_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(*) FROM lineitem) > 10000 AS truncated FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10000""",
)
def capped_rows(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return limit_with_flag(t.lineitem.select(*cols).orderBy(*cols), 10_000)

"""Registered queries of the streaming operators, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import aggregates
from strandline.operators.ordered import first_per_key
from strandline.plans.filter_queries import with_headers
from strandline.plans.fixtures import NOW_S
from strandline.plans.join_queries import last_positions
from strandline.plans.registry import query
from strandline.session import block_of, scratch_path
from strandline.streaming import alerts, catalog_log, journal, positions, records, stateful
from strandline.streaming.tables import StateTable, appended, fold_stream, keyed_result, per_batch, resumable

DAY = 86_400


def _event_time(df, column="ts_s"):
    return df.withColumn("ts", F.timestamp_seconds(column))


@query(
    "T01_replicate_stream",
    """WITH k AS (SELECT * FROM records WHERE NOT coalesce(lower(trim(origin)) IN ('dc1', 'dc2'), false) AND coalesce(try_cast(trim(hop) AS INT), 0) < 3),
        f AS (SELECT *, CASE WHEN payload_hex IS NULL OR length(payload_hex) < 10 THEN 'PASSTHROUGH' WHEN payload_hex LIKE '00%' THEN 'CONFLUENT_AVRO'
               WHEN substr(payload_hex, 1, 2) IN ('02', '03') AND length(payload_hex) >= 18 THEN 'HWX_AVRO' ELSE 'PASSTHROUGH' END AS fmt FROM k),
        i AS (SELECT *, CASE fmt WHEN 'CONFLUENT_AVRO' THEN CAST('0x' || substr(payload_hex, 3, 8) AS BIGINT) WHEN 'HWX_AVRO' THEN CAST('0x' || substr(payload_hex, 3, 16) AS BIGINT) END AS sid FROM f)
        SELECT i.topic, i.part, i.rec_offset, i.payload_hex IS NULL AS is_tombstone, i.sid IS NOT NULL AND s.target_id IS NULL AS id_missing,
          CASE WHEN s.target_id IS NULL THEN payload_hex WHEN fmt = 'CONFLUENT_AVRO' THEN '00' || lpad(hex(s.target_id), 8, '0') || substr(payload_hex, 11)
               ELSE '00' || lpad(hex(s.target_id), 8, '0') || substr(payload_hex, 19) END AS value_hex,
          'trace=' || rec_key || ';X-Repl-Origin=' || coalesce(origin, 'dc1') || ';X-Repl-Hop=' || (coalesce(try_cast(trim(hop) AS INT), 0) + 1) AS headers
        FROM i LEFT JOIN schema_ids s ON s.topic = i.topic AND s.source_id = i.sid""",
)
def replicate_stream(t):
    out = records.replicate(with_headers(t.stream("records")), t.schema_ids, "dc1", "dc2")
    shown = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))
    flat = out.select(
        "topic", "part", "rec_offset", "is_tombstone", "id_missing", F.hex("value").alias("value_hex"),
        F.array_join(shown, ";").alias("headers"),
    )
    return appended(flat, "replicate")


@query(
    "T03_stream_lag",
    f"SELECT topic, max(greatest(0, {NOW_S}000 - ts_ms)) AS lag_ms FROM records GROUP BY topic",
)
def stream_lag(t):
    return keyed_result(records.stream_lag(t.stream("records"), NOW_S * 1000), ["topic"], "lag")


@query("T04_dedupe_records", "SELECT topic, part, rec_offset FROM records")
def dedupe_records(t):
    doubled = t.stream("records").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    timed = doubled.withColumn("ts", F.timestamp_millis("ts_ms"))
    once = records.dedupe_records(timed, "ts", "60 days")
    return appended(once.select("topic", "part", "rec_offset"), "dedupe")


_STAGED = "(regexp_matches({0}, '/_temporary|/\\.hive-staging|/\\.spark-staging|/\\.staging|/\\.tmp|/\\.Trash') OR regexp_matches({0}, '\\.(tmp|crc|inprogress)$'))"
_UNDER = "starts_with(coalesce({0}, ''), '/wh/db' || job_id || '.db/')"
_ALLOWED = """CASE WHEN NOT sync_deletes THEN false WHEN NOT companion THEN true
   WHEN len(string_split(substr({0}, length('/wh/db' || job_id || '.db') + 2), '/')) = 1 THEN delete_table_dirs ELSE delete_inside_tables END"""


def _plan_sql() -> str:
    u, s, d = (lambda c: _UNDER.format(c)), (lambda c: _STAGED.format(c)), (lambda c: _ALLOWED.format(c))
    target = "'hdfs://dr:9000/mirror/db' || job_id || '.db/' || substr({0}, length('/wh/db' || job_id || '.db') + 2)"
    return f"""p AS (
      SELECT txid, job_id, 'COPY' AS action, path AS file, {target.format('path')} AS target_file, size AS bytes FROM fs_journal CROSS JOIN stream_jobs
        WHERE op = 'CLOSE' AND {u('path')} AND NOT {s('path')}
      UNION ALL SELECT txid, job_id, 'COPY', dst, {target.format('dst')}, size FROM fs_journal CROSS JOIN stream_jobs
        WHERE op = 'RENAME' AND {u('dst')} AND NOT {s('dst')}
      UNION ALL SELECT txid, job_id, 'DELETE', src, {target.format('src')}, NULL FROM fs_journal CROSS JOIN stream_jobs
        WHERE op = 'RENAME' AND {u('src')} AND NOT {s('src')} AND (NOT {u('dst')} OR NOT {s('dst')}) AND {d('src')}
      UNION ALL SELECT txid, job_id, 'DELETE', path, {target.format('path')}, NULL FROM fs_journal CROSS JOIN stream_jobs
        WHERE op = 'UNLINK' AND {u('path')} AND NOT {s('path')} AND {d('path')})"""


@query("T05_journal_to_plan", f"WITH {_plan_sql()} SELECT * FROM p")
def journal_to_plan(t):
    return appended(journal.journal_to_plan(t.stream("fs_journal"), t.stream_jobs), "plan")


@query(
    "T06_apply_plan",
    f"WITH {_plan_sql()} SELECT job_id, file, txid, action FROM p QUALIFY row_number() OVER (PARTITION BY job_id, file ORDER BY txid DESC) = 1",
)
def apply_plan(t):
    plan = journal.journal_to_plan(t.stream("fs_journal"), t.stream_jobs).select("job_id", "file", "txid", "action")
    # a job's file may come again in a later micro-batch: the last action over all of them counts
    every = per_batch(plan, "tasks", journal.last_state).drop("epoch")
    return first_per_key(every, ["job_id", "file"], [F.desc("txid")])


@query("T05_resumed_plan", f"WITH {_plan_sql()} SELECT * FROM p")
def resumed_plan(t):
    files, path = scratch_path(t.spark, "journal"), scratch_path(t.spark, "resumed")
    for part in (range(2), range(2, 4)):  # the second run finds the position of the first
        events = t.stream_in_parts("fs_journal", "txid", 4, files, part)
        plan = resumable(events, path, lambda batch: journal.journal_to_plan(batch, t.stream_jobs), high="txid")
    return plan.drop("epoch")


@query("T06_resumed_positions", f"WITH {_plan_sql()} SELECT job_id, max(txid) AS txid FROM p GROUP BY job_id")
def resumed_positions(t):
    files, path = scratch_path(t.spark, "journal"), scratch_path(t.spark, "resumed")
    for part in (range(2), range(2, 4)):
        plan = journal.journal_to_plan(t.stream_in_parts("fs_journal", "txid", 4, files, part), t.stream_jobs).select("job_id", "txid")
        table = StateTable(t.spark, plan.schema, path)
        moved = fold_stream(plan, table, lambda state, batch, _: journal.advance(state, journal.batch_progress(batch)))
    return moved


@query("T06_positions", f"WITH {_plan_sql()} SELECT job_id, max(txid) AS txid FROM p GROUP BY job_id")
def plan_positions(t):
    plan = journal.journal_to_plan(t.stream("fs_journal"), t.stream_jobs).select("job_id", "txid")
    table = StateTable(t.spark, plan.schema, scratch_path(t.spark, "positions"))
    return fold_stream(plan, table, lambda state, batch, _: journal.advance(state, journal.batch_progress(batch)))


@query(
    "T07_expand_dirs",
    f"""WITH {_plan_sql()}, m AS (SELECT DISTINCT '/wh/db' || (l_suppkey % 30) || '.db/t' || (l_partkey % 9) || '/f' || (l_linenumber % 7) AS path, CAST(l_linenumber AS BIGINT) AS size FROM lineitem)
        SELECT p.txid, p.job_id, m.path AS file, m.size AS bytes FROM p JOIN m ON m.path = p.file OR starts_with(m.path, p.file || '/') WHERE p.action = 'COPY'""",
)
def expand_dirs(t):
    path = F.concat(
        F.lit("/wh/db"), F.col("l_suppkey") % 30, F.lit(".db/t"), F.col("l_partkey") % 9, F.lit("/f"), F.col("l_linenumber") % 7
    )
    manifest = t.lineitem.select(path.alias("path"), F.col("l_linenumber").cast("long").alias("size")).distinct()
    plan = journal.journal_to_plan(t.stream("fs_journal"), t.stream_jobs)
    return appended(journal.expand_dirs(plan, manifest), "expand")


@query(
    "T08_apply_catalog_events",
    """WITH h AS (SELECT *, renamed_to IS NOT NULL AND upper(event_type) = 'ALTER_TABLE' AS ren FROM catalog_events WHERE upper(event_type) IN ('CREATE_TABLE', 'ALTER_TABLE', 'DROP_TABLE', 'INSERT')),
        c AS (SELECT CASE WHEN ren THEN renamed_to ELSE table_name END AS table_name, event_id, payload, CASE WHEN upper(event_type) = 'DROP_TABLE' THEN 'delete' ELSE 'upsert' END AS change FROM h
              UNION ALL SELECT table_name, event_id, payload, 'delete' FROM h WHERE ren)
        SELECT table_name, '' AS part_name, event_id, CAST(payload AS BIGINT) AS payload FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY event_id DESC) AS rn FROM c) x WHERE rn = 1 AND change = 'upsert'""",
)
def apply_catalog_events(t):
    events = t.stream("catalog_events").withColumn("part_name", F.lit("")).withColumn("payload", F.col("payload").cast("long"))
    return catalog_log.catalog_state(appended(catalog_log.object_changes(events), "catalog"))


@query(
    "T08_partition_changes",
    """WITH h AS (SELECT *, renamed_to IS NOT NULL AND upper(event_type) = 'ALTER_TABLE' AS ren, upper(event_type) LIKE '%_TABLE' AS whole FROM partition_events),
        c AS (SELECT CASE WHEN ren THEN renamed_to ELSE table_name END AS table_name, CASE WHEN whole THEN '' ELSE coalesce(part_name, '') END AS part_name, event_id, payload,
                CASE WHEN upper(event_type) LIKE 'DROP%' THEN 'delete' ELSE 'upsert' END AS change, CAST(NULL AS VARCHAR) AS moved_to FROM h
              UNION ALL SELECT table_name, '', event_id, payload, 'delete', renamed_to FROM h WHERE ren),
        e AS (SELECT *, lag(event_id) OVER (PARTITION BY table_name ORDER BY event_id) AS prev FROM c WHERE part_name = '' AND change = 'delete'),
        w AS (SELECT event_id AS id, table_name, event_id AS at, 0 AS hops FROM c WHERE part_name <> ''
              UNION ALL SELECT w.id, e.moved_to, e.event_id, w.hops + 1 FROM w JOIN e ON e.table_name = w.table_name AND e.event_id > w.at AND coalesce(e.prev, -1) <= w.at),
        f AS (SELECT id, arg_max(coalesce(table_name, '<gone>'), hops) AS table_name FROM w GROUP BY id),
        a AS (SELECT f.table_name, c.part_name, c.event_id, c.payload, c.change FROM c JOIN f ON f.id = c.event_id WHERE c.part_name <> '' AND f.table_name <> '<gone>'
              UNION ALL SELECT table_name, part_name, event_id, payload, change FROM c WHERE part_name = '')
        SELECT table_name, part_name, event_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY table_name, part_name ORDER BY event_id DESC) AS rn FROM a) x WHERE rn = 1 AND change = 'upsert'""",
)
def partition_changes(t):
    return catalog_log.catalog_state(appended(catalog_log.object_changes(t.stream("partition_events")), "partitions"))


_LETTERS = """e AS (SELECT user_id AS job_id, event_id, value < 100 AS ok, CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 1 END AS before FROM events),
        n AS (SELECT *, CASE WHEN ok THEN 0 ELSE coalesce(before, 0) + 1 END AS attempts FROM e),
        s AS (SELECT job_id, min(event_id) AS stop FROM n WHERE NOT ok AND attempts < 3 GROUP BY job_id),
        o AS (SELECT n.job_id, n.event_id, n.attempts, CASE WHEN n.event_id > s.stop THEN 'PENDING' WHEN n.event_id = s.stop THEN 'RETRY' WHEN n.ok THEN 'APPLIED' ELSE 'DLQ_ISOLATED' END AS outcome
              FROM n LEFT JOIN s ON n.job_id = s.job_id)"""


def _outcomes(t):
    events = t.events.select(F.col("user_id").alias("job_id"), "event_id", (F.col("value") < 100).alias("ok"))
    tries = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1)
    attempts = t.events.select(F.col("user_id").alias("job_id"), "event_id", tries.alias("attempts"))
    return catalog_log.split_dead_letters(events, attempts.filter(F.col("attempts").isNotNull()), 3)


@query("T09_split_dead_letters", f"WITH {_LETTERS} SELECT job_id, event_id, attempts, outcome FROM o")
def split_dead_letters(t):
    return _outcomes(t).select("job_id", "event_id", "attempts", "outcome")


@query(
    "T10_replay",
    f"""WITH {_LETTERS}, d AS (SELECT job_id, event_id FROM o WHERE outcome = 'DLQ_ISOLATED')
        SELECT job_id, event_id, CASE WHEN job_id % 2 = 0 THEN 'REPLAYED' WHEN job_id % 3 = 0 THEN 'IGNORED' ELSE 'ISOLATED' END AS status FROM d""",
)
def replay(t):
    outcomes = _outcomes(t)
    none = outcomes.select("job_id", "event_id", F.lit("").alias("status")).limit(0)
    dlq = catalog_log.dead_letters(outcomes, none)
    replayed = catalog_log.replay(dlq, dlq.filter(F.col("job_id") % 2 == 0))
    return catalog_log.skip(replayed, dlq.filter((F.col("job_id") % 2 != 0) & (F.col("job_id") % 3 == 0)))


@query(
    "T10_replay_positions",
    f"""WITH {_LETTERS}, d AS (SELECT job_id, min(event_id) - 1 AS b FROM o WHERE outcome = 'DLQ_ISOLATED' GROUP BY job_id), p AS (SELECT user_id AS job_id, max(event_id) AS event_id FROM events GROUP BY user_id)
        SELECT p.job_id, least(p.event_id, coalesce(d.b, p.event_id)) AS event_id FROM p LEFT JOIN d ON p.job_id = d.job_id""",
)
def replay_positions(t):
    ends = t.events.groupBy(F.col("user_id").alias("job_id")).agg(F.max("event_id").alias("event_id"))
    return catalog_log.replay_positions(ends, _outcomes(t).filter(F.col("outcome") == "DLQ_ISOLATED"))


@query(
    "T11_event_lag",
    """WITH l AS (SELECT event_type AS log, max(event_id) AS c FROM events GROUP BY 1), p AS (SELECT user_id AS job_id, event_type AS log, min(event_id) AS e FROM events GROUP BY 1, 2)
       SELECT p.job_id, p.log, greatest(0, l.c - p.e) AS lag FROM p JOIN l ON p.log = l.log""",
)
def event_lag(t):
    log = t.events.select(F.col("event_type").alias("log"), "event_id")
    read = t.events.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("log")).agg(
        F.min("event_id").alias("event_id")
    )
    return catalog_log.event_lag(log, read, "log")


@query(
    "T12_recover_gap",
    """SELECT s.rel_path, 'COPY' AS action FROM source_files s LEFT JOIN target_files t ON s.rel_path = t.rel_path
         WHERE NOT coalesce(s.size > 0 AND s.size = t.size AND (s.mtime_s <= 0 OR t.mtime_s <= 0 OR t.mtime_s >= s.mtime_s), false)
       UNION ALL SELECT t.rel_path, 'DELETE' FROM target_files t WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.rel_path = t.rel_path)""",
)
def recover_gap(t):
    return journal.recover_gap(t.source_files, t.target_files)


_RATE = f"""l AS (SELECT site, ts_s, messages, lag(messages) OVER (PARTITION BY site, agent ORDER BY seq) AS p FROM samples),
       g AS (SELECT site, CAST(floor(ts_s / {DAY // 4}) * {DAY // 4} AS BIGINT) AS slide, CASE WHEN p IS NULL THEN 0 WHEN messages < p THEN messages ELSE messages - p END AS inc FROM l),
       w AS (SELECT site, slide - i * {DAY // 4} AS window_start_s, inc FROM g, range(4) r(i)),
       t AS (SELECT site, window_start_s, CAST(sum(inc) AS DOUBLE) / {DAY} AS rate FROM w GROUP BY ALL)"""


def _rates(t):
    return alerts.counter_rate(
        t.samples, ["site", "agent"], ["site"], F.col("messages"), F.col("ts_s"), block_of(F.col("seq")), DAY, DAY // 4
    )


@query("T13_counter_rate", f"WITH {_RATE} SELECT site, window_start_s, round(rate, 8) AS rate FROM t")
def counter_rate(t):
    return _rates(t).withColumn("rate", F.round("rate", 8))


@query(
    "T14_error_ratio_alert",
    f"""WITH s AS (SELECT user_id % 5 AS site, kind, ts_s, CAST(floor(ts_s / {DAY // 4}) * {DAY // 4} AS BIGINT) AS slide FROM (SELECT agent AS user_id, kind, ts_s FROM samples) y),
        w AS (SELECT site, slide - i * {DAY // 4} AS window_start_s, kind FROM s, range(4) r(i)),
        g AS (SELECT site, window_start_s, count(*) FILTER (WHERE kind = 'error') AS hits, count(*) AS rows FROM w GROUP BY ALL)
        SELECT site, window_start_s, hits, rows FROM g WHERE CAST(hits AS DOUBLE) / rows > 0.2""",
)
def error_ratio_alert(t):
    stream = _event_time(t.stream("samples")).withColumn("site", F.col("agent") % 5)
    ratios = alerts.windowed_ratio(stream, "ts", ["site"], F.col("kind") == "error", "1 day", "6 hours")
    flat = ratios.select("site", F.unix_seconds("window.start").alias("window_start_s"), "hits", "rows")
    return alerts.ratio_alert(keyed_result(flat, ["site", "window_start_s"], "ratio"), 0.2)


@query(
    "T15_histogram_quantile",
    """WITH b(le, v) AS (VALUES ('0.1', 0.1e0), ('0.5', 0.5e0), ('1.0', 1.0e0), ('5.0', 5.0e0), ('10.0', 10.0e0), ('30.0', 30.0e0), ('60.0', 60.0e0), ('300.0', 300.0e0), ('+Inf', 1e18)),
        s AS (SELECT id % 3 AS cluster, duration_ms / 1000.0e0 AS d FROM statements),
        h AS (SELECT s.cluster, b.v, count(*) FILTER (WHERE s.d <= b.v) AS n FROM s CROSS JOIN b GROUP BY ALL),
        l AS (SELECT *, lag(v, 1, 0.0e0) OVER w AS low, lag(n, 1, 0) OVER w AS below, max(n) OVER (PARTITION BY cluster) * 0.95e0 AS rk FROM h WINDOW w AS (PARTITION BY cluster ORDER BY v)),
        f AS (SELECT cluster, v, CASE WHEN v > 1e17 THEN low ELSE low + (v - low) * (rk - below) / nullif(n - below, 0) END AS q FROM l WHERE n >= rk AND rk > 0)
        SELECT cluster, round(arg_min(q, v), 6) AS quantile FROM f GROUP BY cluster""",
)
def histogram_quantile(t):
    rows = t.statements.withColumn("cluster", F.col("id") % 3)
    buckets = aggregates.cumulative_histogram(rows, F.col("duration_ms") / 1000.0, aggregates.DURATION_BOUNDS_S, ["cluster"])
    return alerts.histogram_quantile(buckets, 0.95, ["cluster"]).withColumn("quantile", F.round("quantile", 6))


@query(
    "T16_sustained",
    """WITH s AS (SELECT agent, seq, ts_s, lag_ms > 20 AS c, lag(lag_ms > 20) OVER (PARTITION BY agent ORDER BY seq) AS w FROM samples),
        i AS (SELECT *, last_value(CASE WHEN c AND NOT coalesce(w, false) THEN ts_s END IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since_s FROM s)
        SELECT agent, seq, since_s FROM i WHERE c AND ts_s - since_s >= 40000""",
)
def sustained(t):
    rows = t.samples.select("agent", "seq", "ts_s", "lag_ms")
    out = alerts.sustained(
        rows, ["agent"], "seq", F.col("ts_s"), F.col("lag_ms") > 20, 40_000, block_of(F.col("seq"))
    )
    return out.select("agent", "seq", "since_s")


#: How late a row may be, in seconds; what lies past the last watermark is still open.
LATE = 3600


@query(
    "T16_sustained_stream",
    f"""WITH u AS (SELECT max(ts_s) - {LATE} AS upto FROM samples),
        s AS (SELECT agent, seq, ts_s, lag_ms > 20 AS c, lag(lag_ms > 20) OVER (PARTITION BY agent ORDER BY ts_s, seq) AS w,
                min(CASE WHEN NOT lag_ms > 20 THEN ts_s END) OVER (PARTITION BY agent ORDER BY ts_s, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS broken
              FROM samples, u WHERE ts_s <= upto)
        SELECT agent, ts_s AS since_s, ts_s + 40000 AS fired_s FROM s, u WHERE c AND NOT coalesce(w, false) AND ts_s + 40000 <= upto AND coalesce(broken > ts_s + 40000, true)""",
)
def sustained_stream(t):
    rows = t.stream_in_parts("samples", "ts_s", 4)
    out = stateful.sustained_stream(rows, ["agent"], F.col("seq"), F.col("ts_s"), F.col("lag_ms") > 20, 40_000, f"{LATE} seconds")
    return appended(out, "sustained")


@query(
    "T17_starvation",
    """WITH w AS (SELECT CAST(floor(ts_s / 300) * 300 AS BIGINT) AS window_start_s, count(*) FILTER (WHERE kind = 'view' AND value > 60) AS workers, count(*) FILTER (WHERE kind <> 'view') AS queued FROM samples GROUP BY 1)
       SELECT * FROM w WHERE workers = 0 AND queued > 0""",
)
def starvation(t):
    working = (F.col("kind") == "view") & (F.col("value") > 60)
    return alerts.starvation(t.samples, F.col("ts_s"), 300, working, F.col("kind") != "view")


@query(
    "T18_liveness",
    f"""WITH s AS (SELECT agent, max(ts_s) AS seen_s FROM samples GROUP BY agent)
        SELECT agent, seen_s, CASE WHEN {NOW_S} - seen_s >= 21600 THEN 'OFFLINE' WHEN {NOW_S} - seen_s >= 7200 THEN 'SUSPECT' ELSE 'ONLINE' END AS status FROM s WHERE {NOW_S} - seen_s < 172800""",
)
def liveness(t):
    seen = keyed_result(alerts.last_seen(t.stream("samples"), "agent"), ["agent"], "seen")
    return alerts.liveness(seen, NOW_S, 7200, 21_600, 172_800)


@query(
    "T18_liveness_stream",
    f"""WITH u AS (SELECT max(ts_s) - {LATE} AS upto FROM samples), s AS (SELECT DISTINCT agent, ts_s FROM samples, u WHERE ts_s <= upto),
        l AS (SELECT *, lag(ts_s) OVER (PARTITION BY agent ORDER BY ts_s) AS p, lead(ts_s) OVER (PARTITION BY agent ORDER BY ts_s) AS n FROM s),
        x(seconds, status) AS (VALUES (7200, 'SUSPECT'), (21600, 'OFFLINE'), (172800, 'EVICTED'))
        SELECT agent, ts_s AS at_s, 'ONLINE' AS status FROM l WHERE p IS NULL OR ts_s - p > 7200
        UNION ALL SELECT agent, ts_s + seconds, status FROM l, x, u WHERE ts_s + seconds < coalesce(n, upto + 1)""",
)
def liveness_stream(t):
    rows = t.stream_in_parts("samples", "ts_s", 4)
    return appended(stateful.liveness_stream(rows, "agent", F.col("ts_s"), f"{LATE} seconds", 7200, 21_600, 172_800), "alive")


@query(
    "T19_idle_sessions",
    f"WITH s AS (SELECT agent, max(ts_s) AS seen_s FROM samples GROUP BY agent) SELECT agent, seen_s FROM s WHERE seen_s < {NOW_S} - 43200",
)
def idle_sessions(t):
    seen = keyed_result(alerts.last_seen(t.stream("samples"), "agent"), ["agent"], "idle")
    return alerts.idle_sessions(seen, NOW_S, 43_200)


@query(
    "T19_activity_sessions",
    """WITH l AS (SELECT agent, seq, ts_s, lag(ts_s) OVER (PARTITION BY agent ORDER BY seq) AS p FROM samples),
        n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_s - p >= 28800 THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY seq) AS session_no FROM l)
        SELECT agent, CAST(session_no AS BIGINT) AS session_no, min(ts_s) AS start_s, max(ts_s) AS end_s, count(*) AS events FROM n GROUP BY agent, session_no""",
)
def activity_sessions(t):
    rows = t.samples.select("agent", "seq", "ts_s")
    return alerts.activity_sessions(rows, "agent", "seq", "ts_s", 28_800, block_of(F.col("seq")))


@query(
    "T20_progress_deltas",
    "SELECT job_id, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(file_count) AS BIGINT) AS files FROM tasks WHERE status = 'COMPLETED' GROUP BY job_id",
)
def progress_deltas(t):
    done = t.stream("tasks").filter(F.col("status") == "COMPLETED")
    deltas = done.select("job_id", F.col("file_size").alias("bytes"), F.col("file_count").alias("files"))
    return keyed_result(positions.progress_deltas(deltas), ["job_id"], "deltas")


_TURNS = """b AS (SELECT conv_id AS part, turn AS seq, CASE WHEN turn = 5 THEN NULL WHEN role = 'system' THEN turn * 10 - 2 WHEN turn = 3 AND length(text) > 300 THEN 1 ELSE turn * 10 - 1 END AS prev_max, turn * 10 + 9 AS max_offset FROM conversations)"""


@query(
    "T21_accept_in_order",
    f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS n FROM b),
        g AS (SELECT part, seq, n, true AS accepted, max_offset AS pos FROM r WHERE n = 1
          UNION ALL SELECT r.part, r.seq, r.n, r.prev_max IS NULL OR r.prev_max = g.pos, CASE WHEN r.prev_max IS NULL OR r.prev_max = g.pos THEN r.max_offset ELSE g.pos END
          FROM g JOIN r ON r.part = g.part AND r.n = g.n + 1)
        SELECT part, seq, accepted FROM g""",
)
def accept_in_order(t):
    turn = F.col("turn")
    prev = F.when(turn == 5, None).when(F.col("role") == "system", turn * 10 - 2).when(
        (turn == 3) & (F.length("text") > 300), 1
    ).otherwise(turn * 10 - 1)
    batches = t.stream("conversations").select(
        F.col("conv_id").alias("part"), turn.alias("seq"), prev.cast("long").alias("prev_max"), (turn * 10 + 9).alias("max_offset")
    )
    return records.accept_stream(batches, "accepted").select("part", "seq", "accepted")


@query(
    "T22_first_terminal",
    "SELECT agent, min(seq) AS seq, arg_min(kind, seq) AS status FROM samples WHERE kind IN ('purchase', 'error') GROUP BY agent",
)
def first_terminal(t):
    events = t.stream("samples").select("agent", "seq", F.col("kind").alias("status"))
    return keyed_result(positions.first_terminal(events, "agent", ["purchase", "error"]), ["agent"], "terminal")


@query("T23_monotonic_position", "SELECT agent, max(messages) AS messages FROM samples GROUP BY agent")
def monotonic_position(t):
    return keyed_result(positions.monotonic_position(t.stream("samples"), "agent", "messages"), ["agent"], "position")


@query(
    "T24_sync_offsets",
    """WITH l AS (SELECT topic, part, arg_max(ts_ms, rec_offset) AS last_ms, max(rec_offset) AS end_offset FROM records GROUP BY topic, part),
        e AS (SELECT topic, part, rec_offset, ts_ms FROM records WHERE size > 60),
        a AS (SELECT trim(group_id) AS group_id, topic, part, committed FROM groups WHERE NOT (trim(group_id) = '' OR regexp_full_match(trim(group_id), '(connect-.*|schema-registry-.*|console-consumer-.*|kafka-exporter-.*|__.*)'))),
        r AS (SELECT a.group_id, a.topic, a.part, CASE WHEN e.ts_ms > 0 THEN e.ts_ms WHEN a.committed >= l.end_offset THEN l.last_ms ELSE 0 END AS ts_ms
              FROM a LEFT JOIN e ON e.topic = a.topic AND e.part = a.part AND e.rec_offset = a.committed LEFT JOIN l ON l.topic = a.topic AND l.part = a.part),
        f AS (SELECT r.group_id, r.topic, r.part, (SELECT min(x.rec_offset + 7) FROM records x WHERE x.topic = r.topic AND x.part = r.part AND x.ts_ms >= r.ts_ms) AS target_offset FROM r WHERE r.ts_ms > 0),
        c AS (SELECT trim(group_id) AS group_id, topic, part, CASE WHEN part < 4 THEN committed + 50 ELSE committed - 50 END AS committed FROM groups WHERE part <> 1)
        SELECT f.group_id, f.topic, f.part, f.target_offset FROM f LEFT JOIN c ON c.group_id = f.group_id AND c.topic = f.topic AND c.part = f.part
        WHERE f.target_offset IS NOT NULL AND (c.committed IS NULL OR f.target_offset >= c.committed) AND length(f.group_id) % 2 = 1""",
)
def sync_offsets(t):
    groups = t.groups
    exact = t.records.filter(F.col("size") > 60).select("topic", "part", "rec_offset", "ts_ms")
    target_log = t.records.withColumn("rec_offset", F.col("rec_offset") + 7)
    named = groups.withColumn("group_id", F.trim("group_id"))
    shift = F.when(F.col("part") < 4, F.col("committed") + 50).otherwise(F.col("committed") - 50)
    current = named.filter(F.col("part") != 1).withColumn("committed", shift)
    live = named.select(
        "group_id", F.when(F.length("group_id") % 2 == 0, "ACTIVE").otherwise("INACTIVE").alias("liveness")
    ).distinct()
    return positions.sync_offsets(groups, exact, last_positions(t.records), target_log, current, live)


@query("T25_spike_alert", f"WITH {_RATE} SELECT site, window_start_s, round(rate, 8) AS rate FROM t WHERE rate > 0.5")
def spike_alert(t):
    return alerts.spike_alert(_rates(t), 0.5).withColumn("rate", F.round("rate", 8))



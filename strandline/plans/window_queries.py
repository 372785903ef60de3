"""Registered queries of the rankings, pages, gaps and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import ordered, packing
from strandline.operators import windows as win
from strandline.plans.fixtures import ORDERS_NOW_S
from strandline.plans.registry import query
from strandline.session import block_of


@query(
    "W01_latest_per_key",
    """SELECT parent_id, id, status, completed_s FROM jobs
       QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY completed_s DESC NULLS LAST, id DESC) = 1""",
)
def latest_per_key(t):
    jobs = t.jobs.select("parent_id", "id", "status", "completed_s")
    return win.latest_per_key(jobs, ["parent_id"], ["completed_s", "id"])


@query(
    "W02_dedupe_last",
    """SELECT path, txid, op FROM fs_journal WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY txid DESC) = 1""",
)
def dedupe_last(t):
    rows = t.fs_journal.filter(F.col("path").isNotNull()).select("path", "txid", "op")
    return win.latest_per_key(rows, ["path"], ["txid"])


@query("W02_batch_position", "SELECT op, max(txid) AS max_txid, arg_max(size, txid) AS size FROM fs_journal GROUP BY op")
def batch_position(t):
    return win.batch_position(t.fs_journal, ["op"], "txid", "size")


@query(
    "W03_history",
    "SELECT id, sql_text, created_s FROM statements WHERE username = 'u7' ORDER BY created_s DESC, id DESC LIMIT 20 OFFSET 10",
)
def history(t):
    mine = t.statements.filter(F.col("username") == "u7").select("id", "sql_text", "created_s")
    return win.page(mine, [F.desc("created_s"), F.desc("id")], 10, 20)


@query(
    "W04_page",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 100",
)
def page(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.lineitem.select(*cols, "l_extendedprice")
    return win.page(rows, [F.desc("l_extendedprice"), *[F.col(c) for c in cols]], 100, 50)


@query(
    "W05_limit_with_flag",
    "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 100 AS truncated FROM customer ORDER BY c_custkey LIMIT 100",
)
def limit_with_flag(t):
    return win.limit_with_flag(t.customer.select("c_custkey", "c_name").orderBy("c_custkey"), 100)


@query(
    "W06_sort_listing",
    "SELECT doc_id, source AS name, CASE WHEN n_chars < 400 THEN 'DIRECTORY' ELSE 'FILE' END AS kind, n_chars AS size FROM documents",
)
def sort_listing(t):
    kind = F.when(F.col("n_chars") < 400, "DIRECTORY").otherwise("FILE")
    rows = t.documents.select("doc_id", F.col("source").alias("name"), kind.alias("kind"), F.col("n_chars").alias("size"))
    return win.sort_listing(rows, "size", ascending=False)


@query(
    "W07_least_loaded",
    """SELECT cluster_id, agent_id, load FROM members WHERE lower(status) = 'online' AND cluster_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY load, agent_id) = 1""",
)
def least_loaded(t):
    return win.least_loaded(t.members)


@query(
    "W08_affinity_pick",
    """WITH m AS (SELECT cluster_id, agent_id, row_number() OVER (PARTITION BY cluster_id ORDER BY agent_no) - 1 AS slot FROM members WHERE cluster_id IS NOT NULL),
        s AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY cluster_id),
        k AS (SELECT o_orderkey AS id, 'Cluster-' || (o_custkey % 25) AS cluster_id FROM orders)
        SELECT k.id, k.cluster_id, m.agent_id FROM k LEFT JOIN s ON k.cluster_id = s.cluster_id LEFT JOIN m ON m.cluster_id = k.cluster_id AND m.slot = k.id % s.n""",
)
def affinity_pick(t):
    keys = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Cluster-"), F.col("o_custkey") % 25).alias("cluster_id")
    )
    members = t.members.filter(F.col("cluster_id").isNotNull())
    return win.affinity_pick(keys, members, "id", "cluster_id", hash_of=F.col("id"))


@query(
    "W09_expired",
    f"""SELECT updated_s FROM tasks WHERE status IN ('COMPLETED', 'SKIPPED') AND updated_s < {ORDERS_NOW_S - 86400 * 900} ORDER BY updated_s LIMIT 200""",
)
def expired(t):
    return win.expired(t.tasks, ["COMPLETED", "SKIPPED"], ORDERS_NOW_S - 86400 * 900, 200).select("updated_s")


@query(
    "W09_purge",
    f"SELECT job_id, seq, part_id, updated_s FROM tasks WHERE NOT (status IN ('COMPLETED', 'SKIPPED') AND updated_s < {ORDERS_NOW_S - 86400 * 900})",
)
def purge(t):
    return win.purge(t.tasks, ["COMPLETED", "SKIPPED"], ORDERS_NOW_S - 86400 * 900).select("job_id", "seq", "part_id", "updated_s")


@query(
    "W10_due_jobs",
    f"SELECT id, completed_s FROM jobs WHERE job_type = 'ROOT' AND completed_s IS NOT NULL AND completed_s <= {ORDERS_NOW_S - 86400 * 1000}",
)
def due_jobs(t):
    return win.due_jobs(t.jobs, F.col("job_type") == "ROOT", "completed_s", ORDERS_NOW_S - 86400 * 1000).select("id", "completed_s")


@query(
    "W11_committable_offsets",
    """WITH o AS (SELECT part, min(seq) AS s FROM batches WHERE NOT settled GROUP BY part)
       SELECT b.part, max(b.max_offset) + 1 AS commit_offset FROM batches b LEFT JOIN o ON b.part = o.part WHERE b.settled AND (o.s IS NULL OR b.seq < o.s) GROUP BY b.part""",
)
def committable_offsets(t):
    return win.committable_offsets(t.batches)


@query(
    "W12_sequence_gaps",
    """WITH b AS (SELECT part, seq, max_offset, CASE WHEN settled THEN prev_max ELSE NULL END AS prev_max FROM batches),
        l AS (SELECT *, lag(max_offset) OVER (PARTITION BY part ORDER BY seq) AS accepted FROM b)
        SELECT part, seq, accepted, accepted IS NULL OR prev_max IS NULL OR prev_max = accepted AS in_sequence FROM l""",
)
def sequence_gaps(t):
    rows = t.batches.withColumn("prev_max", F.when(F.col("settled"), F.col("prev_max")))
    return win.sequence_gaps(rows, block_of(F.col("seq"))).select("part", "seq", "accepted", "in_sequence")


@query(
    "W13_split_batches",
    """WITH r AS (SELECT part, rec_offset, size, row_number() OVER (PARTITION BY part ORDER BY rec_offset) AS n FROM records),
        g AS (SELECT part, rec_offset, n, size AS bytes, 1 AS cnt, CAST(1 AS BIGINT) AS batch_no FROM r WHERE n = 1
          UNION ALL
          SELECT r.part, r.rec_offset, r.n, CASE WHEN g.cnt >= 25 OR g.bytes + r.size > 1500 THEN r.size ELSE g.bytes + r.size END,
                 CASE WHEN g.cnt >= 25 OR g.bytes + r.size > 1500 THEN 1 ELSE g.cnt + 1 END,
                 CASE WHEN g.cnt >= 25 OR g.bytes + r.size > 1500 THEN g.batch_no + 1 ELSE g.batch_no END
          FROM g JOIN r ON r.part = g.part AND r.n = g.n + 1)
        SELECT part, rec_offset, batch_no FROM g""",
)
def split_batches(t):
    rows = t.records.select("part", "rec_offset", "size")
    return packing.split_batches(rows, ["part"], "rec_offset", "size", 25, 1500, width=500).select(
        "part", "rec_offset", "batch_no"
    )


@query(
    "W14_plan_bundles",
    """WITH f AS (SELECT lang, doc_id, n_chars AS size FROM documents),
        r AS (SELECT lang, doc_id, size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM f WHERE size < 2000),
        g AS (SELECT lang, doc_id, n, size AS bytes, 1 AS cnt, CAST(1 AS BIGINT) AS bundle_no FROM r WHERE n = 1
          UNION ALL
          SELECT r.lang, r.doc_id, r.n, CASE WHEN g.cnt >= 8 OR g.bytes >= 6000 THEN r.size ELSE g.bytes + r.size END,
                 CASE WHEN g.cnt >= 8 OR g.bytes >= 6000 THEN 1 ELSE g.cnt + 1 END,
                 CASE WHEN g.cnt >= 8 OR g.bytes >= 6000 THEN g.bundle_no + 1 ELSE g.bundle_no END
          FROM g JOIN r ON r.lang = g.lang AND r.n = g.n + 1)
        SELECT lang, doc_id, bundle_no FROM g UNION ALL SELECT lang, doc_id, NULL FROM f WHERE NOT size < 2000""",
)
def plan_bundles(t):
    files = t.documents.select("lang", "doc_id", F.col("n_chars").alias("size"))
    return packing.plan_bundles(files, ["lang"], "doc_id", 2000, 6000, 8, width=64).select("lang", "doc_id", "bundle_no")


@query(
    "W15_current_session",
    """SELECT username, id, status, created_s FROM statements WHERE status <> 'KILLED' QUALIFY row_number() OVER (PARTITION BY username ORDER BY created_s DESC, id DESC) = 1""",
)
def current_session(t):
    live = t.statements.filter(F.col("status") != "KILLED").select("username", "id", "status", "created_s")
    return win.latest_per_key(live, ["username"], ["created_s", "id"])


@query(
    "W17_log_gap",
    "SELECT min(event_id) FILTER (WHERE event_id > 103) AS first_available, max(event_id) AS current_id, CASE WHEN min(event_id) FILTER (WHERE event_id > 103) > 104 THEN 'GAP' ELSE 'OK' END AS state FROM catalog_events",
)
def log_gap(t):
    return win.log_gap(t.catalog_events, 103)


@query(
    "W17_id_gaps",
    "WITH l AS (SELECT event_id, lead(event_id) OVER (ORDER BY event_id) AS next_id FROM catalog_events) SELECT event_id, next_id FROM l WHERE next_id - event_id > 1",
)
def id_gaps(t):
    return win.id_gaps(t.catalog_events.select("event_id"), block_of(F.col("event_id")))


@query(
    "W18_dead_letters",
    "SELECT id, created_s, status FROM statements WHERE status = 'FAILED' ORDER BY created_s DESC, id LIMIT 100",
)
def dead_letters(t):
    failed = t.statements.filter(F.col("status") == "FAILED").select("id", "created_s", "status")
    return win.page(failed, [F.desc("created_s"), F.col("id")], 0, 100)


@query(
    "W19_root_page",
    "SELECT id, started_s FROM jobs WHERE job_type IS NULL ORDER BY started_s DESC, id LIMIT 50",
)
def root_page(t):
    roots = t.jobs.filter(F.col("job_type").isNull()).select("id", "started_s")
    return win.page(roots, [F.desc("started_s"), F.col("id")], 0, 50)


@query(
    "W20_hysteresis",
    """WITH s AS (SELECT agent, seq, CASE WHEN value >= 90 THEN true WHEN value <= 10 THEN false END AS f FROM samples)
       SELECT agent, seq, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS saturated FROM s""",
)
def hysteresis(t):
    rows = t.samples.select("agent", "seq", "value")
    out = win.hysteresis(rows, ["agent"], ["seq"], block_of(F.col("seq")), F.col("value") / 100.0, 0.9, 0.1)
    return out.select("agent", "seq", "saturated")


@query(
    "W21_prune_runs",
    """WITH l AS (SELECT c_custkey AS job_id, c_nationkey - 3 AS keep_runs FROM customer WHERE c_mktsegment <> 'BUILDING'),
        r AS (SELECT job_id, run_number, status, row_number() OVER (PARTITION BY job_id ORDER BY run_number DESC) AS rn FROM runs)
        SELECT r.job_id, r.run_number, r.status FROM r LEFT JOIN l ON r.job_id = l.job_id WHERE coalesce(l.keep_runs, 0) <= 0 OR r.rn <= l.keep_runs""",
)
def prune_runs(t):
    limits = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("job_id"), (F.col("c_nationkey") - 3).alias("keep_runs")
    )
    runs = t.runs.select("job_id", "run_number", "status")
    return win.prune_runs(runs, limits, block_of(F.col("run_number")))


@query(
    "S12_keyset_page",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey > 150 ORDER BY p_partkey LIMIT 1000",
)
def keyset_page(t):
    return win.keyset_page(t.part.select("p_partkey", "p_name"), "p_partkey", 150, 1000)


@query(
    "S12_keyset_progress",
    "SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey <= 150) AS skipped FROM part",
)
def keyset_progress(t):
    return win.keyset_progress(t.part, "p_partkey", 150)


@query(
    "W04_numbered_rows",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events",
)
def numbered_rows(t):
    rows = t.events.select("user_id", "event_id")
    return ordered.numbered(rows, ["user_id"], ["event_id"], block_of(F.col("event_id")), "age", descending=True)

"""Golden cases of the joins and reconciliations."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregates, joins, sets, windows
from strandline.session import block_of


def test_manifest_diff(spark, rows):
    cols = "rel_path string, size long, mtime_s long"
    source = spark.createDataFrame([("same", 5, 10), ("older", 5, 10), ("grown", 6, 10), ("new", 1, 1), ("empty", 0, 1)], cols)
    target = spark.createDataFrame([("same", 5, 10), ("older", 5, 9), ("grown", 5, 11), ("empty", 0, 5), ("extra", 1, 1)], cols)
    assert rows(joins.manifest_diff(source, target), "rel_path", "action") == [
        ("empty", "QUEUED"),
        ("grown", "QUEUED"),
        ("new", "QUEUED"),
        ("older", "QUEUED"),
        ("same", "SKIPPED"),
    ]


def test_drift_message_is_cut_like_the_whole_text(spark, rows):
    found = [("t", "MISSING_COLUMN", f"c{i:03d}: int") for i in range(200)] + [("u", "SERDE", "a -> b")]
    issues = spark.createDataFrame(found, "table_name string, issue string, detail string")
    got = {r["table_name"]: r for r in joins.drift_report(issues, 120).collect()}
    whole = "; ".join(f"MISSING_COLUMN c{i:03d}: int" for i in range(200))
    assert got["t"]["message"] == whole[:117] + "..."
    assert (got["t"]["issues"], got["u"]["issues"], got["u"]["message"]) == (200, 1, "SERDE a -> b")


def test_mirror_is_the_first_other_job(spark, rows):
    jobs = spark.createDataFrame(
        [(1, "A-1", "b", "/x", "/y"), (2, "B", "a_1", "/y", "/x"), (3, "b", "a1", "/y", "/x"), (4, "s", "S", "/z", "/z"), (5, "c", "d", "/q", "/w")],
        "id long, source_cluster string, target_cluster string, source_path string, target_path string",
    )
    assert rows(joins.mirror_routes(jobs), "id", "mirror_id") == [(1, 2), (2, 1), (3, 1), (4, None), (5, None)]


def test_overlaps(spark, rows):
    jobs = spark.createDataFrame(
        [
            (1, "ACTIVE", "dc1", "dc2", "BIDIRECTIONAL", ["a", "b"]),
            (2, "ACTIVE", "DC2", "dc1", "ONE_WAY", ["b", "c"]),
            (3, "PAUSED", "dc1", "dc2", "ONE_WAY", ["a"]),
            (4, "ACTIVE", "dc3", "dc2", "ONE_WAY", ["a"]),
        ],
        "id long, status string, source_dc string, target_dc string, direction string, topics array<string>",
    )
    shown = lambda df: rows(df.withColumn("s", F.array_join("shared_topics", ",")), "id", "other_id", "s")
    assert shown(joins.find_overlaps(jobs)) == [(1, 2, "b"), (2, 1, "b"), (3, 1, "a")]
    assert shown(joins.find_overlaps(jobs.filter("id <> 1"), active_only=True)) == []


def test_config_diff(spark, rows):
    cols = "path string, label string, capacity double, max_capacity double, state string, policy string, node_labels string"
    live = spark.createDataFrame(
        [("r.a", "D", 10.0, 20.0, "RUNNING", "fifo", "x,y"), ("r.a", "G", 5.0, 9.0, "RUNNING", "fifo", "x,y"),
         ("r.b", "D", 1.0, 2.0, "RUNNING", None, "x"), ("r.c", "D", 1.0, 2.0, "RUNNING", "fifo", "x"),
         ("r.z", "D", 1.0, 2.0, "RUNNING", "fifo", "x")], cols,
    )
    draft = spark.createDataFrame(
        [("r.a", "D", 10.005, 20.0, "RUNNING", "FIFO", "y,x", "modify"), ("r.a", "G", 6.5, 9.0, "RUNNING", "FIFO", "y,x", "modify"),
         ("r.b", "D", 1.0, 2.0, "STOPPED", "fair", "x", "modify"), ("r.c", "D", 1.0, 2.0, "RUNNING", "fifo", "x", "delete"),
         ("r.n", "G", 3.0, 4.0, "RUNNING", "fifo", "x", "create")], cols + ", action string",
    )
    got = rows(joins.config_diff(draft, live, "D"), "path", "label", "action", "delta_capacity")
    assert got == [
        ("r.a", "G", "modified", 1.5),
        ("r.b", "D", "modified", 0.0),
        ("r.c", "D", "deleted", 0.0),
        ("r.n", "G", "created", None),
    ]


def test_offsets_for_times(spark, rows):
    log = spark.createDataFrame([("t", 0, 100, 1), ("t", 0, 300, 2), ("t", 0, 200, 3), ("t", 1, 50, 9)], "topic string, part int, ts_ms long, rec_offset long")
    asked = spark.createDataFrame([("t", 0, 100, 1), ("t", 0, 101, 2), ("t", 0, 250, 3), ("t", 0, 301, 4), ("t", 2, 1, 5)], "topic string, part int, ts_ms long, request_id long")
    for width in (10, 150, 10_000):
        got = rows(joins.offsets_for_times(asked, log, width), "request_id", "target_offset")
        assert got == [(1, 1), (2, 2), (3, 2), (4, None), (5, None)]


def test_offsets_never_go_back(spark, rows):
    key = "group_id string, topic string, part int"
    current = spark.createDataFrame([("g", "t", 0, 10), ("g", "t", 1, 10), ("live", "t", 0, 1)], key + ", committed long")
    proposed = spark.createDataFrame([("g", "t", 0, 9), ("g", "t", 1, 10), ("g", "t", 2, 5), ("live", "t", 0, 7), ("new", "t", 0, 3)], key + ", target_offset long")
    live = spark.createDataFrame([("g", "INACTIVE"), ("live", "ACTIVE")], "group_id string, liveness string")
    assert rows(joins.apply_offsets(current, proposed, live), "group_id", "part") == [("g", 1), ("g", 2)]
    assert len(rows(joins.apply_offsets(current, proposed, live, force=True))) == 5


def test_rewrite_location(spark):
    df = spark.createDataFrame([(u,) for u in ["hdfs://nsA/w/t", "hdfs://NSA:8020/w", "hdfs://prod-nn:1/w", "/w/prod/x", "/w/products", "hdfs://other/w", None]], "location string")
    rules = joins.parse_mappings("nsA=dr, bad, x->")
    assert rules == [("nsA", "dr")]
    got = [tuple(r)[1:] for r in joins.rewrite_location(df, rules, None, "prod", "dr$1").collect()]
    assert got == [
        ("hdfs://dr/w/t", False),
        ("hdfs://dr/w", False),
        ("hdfs://dr$1-nn:1/w", False),
        ("/w/dr$1/x", False),
        ("/w/products", False),
        ("hdfs://other/w", True),
        (None, False),
    ]
    got = [r["target_location"] for r in joins.rewrite_location(df, [("nsA", "s3a://b/")], "hdfs://dr:9/").collect()]
    assert got[:3] == ["s3a://b/w/t", "s3a://b/w", "hdfs://dr:9/w"] and got[3] == "hdfs://dr:9/w/prod/x"


def test_hrw_moves_only_the_lost_endpoint(spark):
    parts = spark.range(200).select(F.col("id").cast("int").alias("part"))
    four = {r["part"]: r["endpoint"] for r in joins.hrw_assign(parts, list("abcd")).collect()}
    three = {r["part"]: r["endpoint"] for r in joins.hrw_assign(parts, list("abc")).collect()}
    assert set(four.values()) == set("abcd")
    assert all(three[p] == e for p, e in four.items() if e != "d")


def test_text_hash_matches_known_values():
    assert [joins._text_hash(s) for s in ("", "a", "hello", "endpoint-1:9095")] == [0, 97, 99162322, joins._text_hash("endpoint-1:9095")]
    assert joins._text_hash("polygenelubricants") == -(2**31)


def test_reconcile_deletes(spark, rows):
    of = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = joins.reconcile_deletes(of("/a", "/b/f", "/c"), of("/b/f", "/c/new"), of("/a/1", "/a/x/2", "/ab/1", "/b/f", "/c/old", "/c/new"))
    assert rows(got) == [("/a/1",), ("/a/x/2",), ("/c/old",)]


def test_remove_subtrees(spark, rows):
    of = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(joins.remove_subtrees(of("r.a", "r.a.b", "r.ab", "r"), of("r.a"))) == [("r",), ("r.ab",)]


def test_translate_offsets(spark, rows):
    groups = spark.createDataFrame([("g", "t", 0, 5), ("h", "t", 0, 9), ("i", "t", 0, 10)], "group_id string, topic string, part int, committed long")
    exact = spark.createDataFrame([("t", 0, 5, 777)], "topic string, part int, rec_offset long, ts_ms long")
    last = spark.createDataFrame([("t", 0, 999, 10)], "topic string, part int, ts_ms long, end_offset long")
    assert rows(joins.translate_offsets(groups, exact, last), "group_id", "ts_ms") == [("g", 777), ("h", 0), ("i", 999)]


def test_counter_survives_restarts(spark):
    samples = [("s", "a", 1, 0, 10, 5), ("s", "a", 2, 1, 30, 5), ("s", "a", 3, 2, 4, 7), ("s", "b", 1, 100_000, 8, 3)]
    df = spark.createDataFrame(samples, "site string, agent string, seq long, ts_ms long, messages long, lag_ms long")
    got = aggregates.counter_total(df, block_of(F.col("seq"), 1), 110_000).first()
    assert (got["messages"], got["max_lag_ms"]) == (30 + 4 + 8, 3)


def test_committable_prefix(spark, rows):
    df = spark.createDataFrame([(0, 1, 9, True), (0, 2, 19, True), (0, 3, 29, False), (0, 4, 39, True), (1, 1, 5, False)], "part int, seq long, max_offset long, settled boolean")
    assert rows(windows.committable_offsets(df)) == [(0, 20)]


def test_log_gap(spark):
    events = spark.createDataFrame([(5,), (6,)], "event_id long")
    state = lambda last, current=None: windows.log_gap(events, last, current).first()["state"]
    assert (state(4), state(3), state(0), state(6), state(9, 6)) == ("OK", "GAP", "OK", "OK", "RESET")


@pytest.mark.parametrize("n,total,flag", [(3, 3, True), (4, 4, False), (10, 4, False)])
def test_limit_with_flag(spark, n, total, flag):
    got = windows.limit_with_flag(spark.range(4), n).collect()
    assert len(got) == total and {r["truncated"] for r in got} == {flag}


def test_prune_runs(spark, rows):
    runs = spark.createDataFrame([(1, i) for i in range(1, 8)] + [(2, 1), (2, 2), (3, 1)], "job_id long, run_number long")
    limits = spark.createDataFrame([(1, 2), (2, 0)], "job_id long, keep_runs int")
    assert rows(windows.prune_runs(runs, limits, block_of(F.col("run_number"), 2))) == [(1, 6), (1, 7), (2, 1), (2, 2), (3, 1)]


def test_logs_equal(spark, rows):
    a = spark.createDataFrame([(0,), (0,), (1,)], "part int")
    b = spark.createDataFrame([(0,), (0,), (2,)], "part int")
    assert rows(sets.logs_equal(a, b, ["part"])) == [(0, 2, 2, True), (1, 1, 0, False), (2, 0, 1, False)]


def test_partition_layout(spark, rows):
    df = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 3, "a"), ("t", 3, "a")], "topic string, part int, agent string")
    assert rows(aggregates.partition_layout(df)) == [("t", 4, 2, 1)]
    assert rows(aggregates.partition_owners(df), "part", "agent") == [(0, "a"), (0, "b"), (1, None), (2, None), (3, "a")]


def test_a_hot_minute_of_the_log_is_one_row_a_millisecond(spark, rows):
    minute = 1_700_000_000_000 // 60_000 * 60_000
    log = spark.range(40_000).select(
        F.lit("t").alias("topic"), F.lit(0).alias("part"), (F.lit(minute) + F.col("id") % 50).alias("ts_ms"), (F.col("id") + 7).alias("rec_offset")
    )
    asked = spark.createDataFrame([("t", 0, minute + k, k) for k in (0, 0, 49, 50, -5)] + [("t", 1, minute, 9)], "topic string, part int, ts_ms long, request_id int")
    out = joins.offsets_for_times(asked, log)
    assert rows(out, "request_id", "target_offset") == sorted(
        [(0, 7), (0, 7), (49, 56), (50, None), (-5, 7), (9, None)], key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    before_window = plan[plan.index("Window") :]
    assert "partial_min" in before_window  # the log is reduced in the map tasks, before it is shuffled

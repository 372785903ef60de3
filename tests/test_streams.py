"""Streams over several micro-batches, replays of a batch, and the folds inside them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandline.session import block_of, scratch_path
from strandline.streaming import alerts, catalog_log, journal, positions, records
from strandline.streaming.tables import StateTable, appended, fold_stream, keyed_result, upsert_by_key


def files_of(folder, batches):
    """One JSON file per batch, so that each becomes a micro-batch."""
    os.makedirs(folder, exist_ok=True)
    for i, batch in enumerate(batches):
        with open(f"{folder}/{i:03d}.json", "w") as out:
            out.write("\n".join(json.dumps(row) for row in batch))
        os.utime(f"{folder}/{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_keyed_result_over_batches(spark, tmp_path, rows):
    files_of(tmp_path / "in", [[{"k": 1, "v": 5}, {"k": 2, "v": 1}], [{"k": 1, "v": 3}], [{"k": 3, "v": 9}, {"k": 2, "v": 7}]])
    source = stream(spark, tmp_path / "in", "k long, v long")
    got = keyed_result(positions.monotonic_position(source, "k", "v"), ["k"], "t")
    assert rows(got) == [(1, 5), (2, 7), (3, 9)]


def test_first_terminal_is_kept(spark, tmp_path, rows):
    files_of(tmp_path / "in", [[{"k": 1, "seq": 1, "status": "RUN"}, {"k": 1, "seq": 2, "status": "DONE"}], [{"k": 1, "seq": 3, "status": "FAILED"}, {"k": 2, "seq": 4, "status": "RUN"}]])
    source = stream(spark, tmp_path / "in", "k long, seq long, status string")
    assert rows(keyed_result(positions.first_terminal(source, "k", ["DONE", "FAILED"]), ["k"], "t")) == [(1, 2, "DONE")]


def test_a_repeated_batch_changes_nothing(spark, rows):
    table = StateTable(spark, "k long, v long", scratch_path(spark, "slots"))
    df = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    step = lambda epoch, batch: table.write(epoch, upsert_by_key(table.before(epoch), batch, ["k"]))
    step(0, df((1, 1), (2, 2)))
    step(1, df((1, 5)))
    step(1, df((1, 5)))
    assert rows(table.after(1)) == [(1, 5), (2, 2)]
    step(2, df((3, 3)))
    assert rows(table.after(2)) == [(1, 5), (2, 2), (3, 3)]


def test_accept_in_order_over_batches(spark, tmp_path, rows):
    row = lambda seq, prev, top, part=0: {"part": part, "seq": seq, "prev_max": prev, "max_offset": top}
    files_of(
        tmp_path / "in",
        [[row(1, 5, 9), row(2, 9, 19)], [row(3, 9, 29), row(4, 19, 39), row(5, 1, 3, part=1)], [row(6, 29, 49), row(7, None, 59), row(8, 59, 69)]],
    )
    source = stream(spark, tmp_path / "in", "part int, seq long, prev_max long, max_offset long")
    got = dict(rows(records.accept_stream(source, "acc"), "seq", "accepted"))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}


EVENT = "event_id long, table_name string, part_name string, event_type string, renamed_to string, payload long"


WANT = [("a", "", 5), ("c", "", 15), ("e", "", 14), ("e", "dt=5", 10), ("e", "dt=6", 13)]


def event(i, kind, table, part=None, to=None, payload=0):
    return {"event_id": i, "event_type": kind, "table_name": table, "part_name": part, "renamed_to": to, "payload": payload}


@pytest.mark.parametrize("cut", [[9], [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14], [3, 6, 13], [12]])
def test_catalog_changes_do_not_depend_on_batches(spark, tmp_path, rows, cut):
    log = [
        event(1, "CREATE_TABLE", "a", payload=1),
        event(2, "ADD_PARTITION", "a", "dt=1", payload=2),
        event(3, "ALTER_TABLE", "b", payload=3),
        event(4, "DROP_TABLE", "a"),
        event(5, "create_table", "a", payload=5),
        event(6, "ADD_PARTITION", "a", "dt=2", payload=6),
        event(7, "ALTER_TABLE", "b", to="c", payload=7),
        event(8, "DROP_PARTITION", "a", "dt=2"),
        event(9, "OPEN_TXN", "z"),
        event(10, "ADD_PARTITION", "c", "dt=5", payload=10),
        event(11, "ADD_PARTITION", "c", "dt=6", payload=11),
        event(12, "ALTER_TABLE", "c", to="d", payload=12),
        event(13, "ADD_PARTITION", "d", "dt=6", payload=13),
        event(14, "ALTER_TABLE", "d", to="e", payload=14),
        event(15, "CREATE_TABLE", "c", payload=15),
    ]
    edges = [0, *cut, len(log)]
    files_of(tmp_path / "in", [log[a:b] for a, b in zip(edges, edges[1:]) if log[a:b]])
    table = StateTable(spark, catalog_log.CATALOG_SCHEMA, scratch_path(spark, "cat"))
    got = fold_stream(stream(spark, tmp_path / "in", EVENT), table, lambda s, b, _: catalog_log.apply_catalog_events(s, b))
    assert rows(got, "table_name", "part_name", "payload") == WANT
    changes = appended(catalog_log.object_changes(stream(spark, tmp_path / "in", EVENT)), "changes")
    assert rows(catalog_log.catalog_state(changes), "table_name", "part_name", "payload") == WANT


def test_dead_letters(spark, rows):
    events = spark.createDataFrame([(1, i, ok) for i, ok in [(1, True), (2, False), (3, True), (4, False), (5, True)]] + [(2, 9, True)], "job_id long, event_id long, ok boolean")
    attempts = spark.createDataFrame([(1, 2, 2)], "job_id long, event_id long, attempts int")
    out = catalog_log.split_dead_letters(events, attempts, 3)
    assert rows(out, "event_id", "outcome") == [(1, "APPLIED"), (2, "DLQ_ISOLATED"), (3, "APPLIED"), (4, "RETRY"), (5, "PENDING"), (9, "APPLIED")]
    assert rows(catalog_log.next_attempts(out, attempts)) == [(1, 4, 1)]
    none = spark.createDataFrame([], "job_id long, event_id long, status string")
    dlq = catalog_log.dead_letters(out, none)
    assert rows(dlq) == [(1, 2, "ISOLATED")]
    assert rows(catalog_log.replay(dlq, dlq), "status") == [("REPLAYED",)]
    ends = spark.createDataFrame([(1, 9), (2, 3)], "job_id long, event_id long")
    assert rows(catalog_log.replay_positions(ends, dlq)) == [(1, 1), (2, 3)]


def test_journal_plan(spark, rows):
    jobs = spark.createDataFrame(
        [(1, "hdfs://nn/wh/db.db/", "/m", True, False, False, False), (2, "/", "/all", False, False, False, False), (3, "/wh", "/w", True, True, False, True)],
        "job_id long, source_path string, target_path string, sync_deletes boolean, companion boolean, delete_table_dirs boolean, delete_inside_tables boolean",
    )
    df = spark.createDataFrame(
        [
            (1, "CLOSE", "/wh/db.db/t/f", None, None, 7),
            (2, "CLOSE", "/wh/db.dbx/f", None, None, 7),
            (3, "CLOSE", "/wh/db.db/_temporary/f", None, None, 7),
            (4, "RENAME", None, "/wh/db.db/_temporary/f", "/wh/db.db/t/g", 7),
            (5, "RENAME", None, "/wh/db.db/t/g", "/wh/db.db/t/h", 7),
            (6, "RENAME", None, "/wh/db.db/t/h", "/out/h", 7),
            (7, "UNLINK", "/wh/db.db", None, None, None),
        ],
        "txid long, op string, path string, src string, dst string, size long",
    )
    got = rows(journal.journal_to_plan(df, jobs), "txid", "job_id", "action", "target_file")
    assert got == sorted(
        [
            (1, 1, "COPY", "/m/t/f"), (1, 2, "COPY", "/all/wh/db.db/t/f"), (1, 3, "COPY", "/w/db.db/t/f"),
            (2, 2, "COPY", "/all/wh/db.dbx/f"), (2, 3, "COPY", "/w/db.dbx/f"),
            (4, 1, "COPY", "/m/t/g"), (4, 2, "COPY", "/all/wh/db.db/t/g"), (4, 3, "COPY", "/w/db.db/t/g"),
            (5, 1, "COPY", "/m/t/h"), (5, 1, "DELETE", "/m/t/g"), (5, 2, "COPY", "/all/wh/db.db/t/h"),
            (5, 3, "COPY", "/w/db.db/t/h"), (5, 3, "DELETE", "/w/db.db/t/g"),
            (6, 1, "DELETE", "/m/t/h"), (6, 2, "COPY", "/all/out/h"), (6, 3, "DELETE", "/w/db.db/t/h"),
            (7, 1, "DELETE", "/m"),
        ]
    )


@pytest.mark.parametrize("cut", [[12], [3, 6, 9], [1, 2, 11]])
def test_error_ratio_does_not_depend_on_batches(spark, tmp_path, rows, cut):
    """Days far apart, newest first: late rows count as well."""
    log = [{"site": i % 2, "s": 86_400 * (12 - i) + 7 * i, "kind": "error" if i % 3 else "view"} for i in range(12)]
    edges = [0, *cut, len(log)]
    files_of(tmp_path / "in", [log[a:b] for a, b in zip(edges, edges[1:]) if log[a:b]])
    source = stream(spark, tmp_path / "in", "site int, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    ratios = alerts.windowed_ratio(source, "ts", ["site"], F.col("kind") == "error", "2 days", "1 day")
    flat = ratios.select("site", F.unix_seconds("window.start").alias("start"), "hits", "rows")
    want = {}
    for row in log:
        for start in (row["s"] // 86_400 * 86_400, row["s"] // 86_400 * 86_400 - 86_400):
            hits, n = want.get((row["site"], start), (0, 0))
            want[row["site"], start] = (hits + (row["kind"] == "error"), n + 1)
    assert sorted(rows(keyed_result(flat, ["site", "start"], "ratio"))) == sorted((*k, *v) for k, v in want.items())


def test_sustained_and_sessions_across_blocks(spark, rows):
    ts = [0, 10, 20, 30, 40, 100, 110]
    on = [1, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i, t, bool(c)) for i, (t, c) in enumerate(zip(ts, on))], "k string, seq long, ts_s long, c boolean")
    for width in (1, 2, 100):
        block = block_of(F.col("seq"), width)
        assert rows(alerts.sustained(df, ["k"], "seq", F.col("ts_s"), F.col("c"), 20, block), "seq", "since_s") == [(2, 0), (5, 40), (6, 40)]
        sessions = alerts.activity_sessions(df, "k", "seq", "ts_s", 60, block)
        assert rows(sessions, "session_no", "start_s", "end_s", "events") == [(1, 0, 40, 5), (2, 100, 110, 2)]


def test_quantile(spark, rows):
    cells = [("a", "1.0", 10), ("a", "2.0", 20), ("a", "+Inf", 20), ("b", "1.0", 1), ("b", "2.0", 1), ("b", "+Inf", 100), ("c", "1.0", 0), ("c", "2.0", 0), ("c", "+Inf", 0)]
    df = spark.createDataFrame(cells, "k string, le string, n long")
    assert rows(alerts.histogram_quantile(df, 0.75, ["k"])) == [("a", 1.5), ("b", 2.0)]


def test_rate_counts_restarts(spark, rows):
    df = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 60, 30), ("a", 3, 120, 5)], "k string, seq long, ts_s long, v long")
    got = alerts.counter_rate(df, ["k"], ["k"], F.col("v"), F.col("ts_s"), block_of(F.col("seq"), 1), 120, 60)
    assert rows(got, "window_start_s", "rate") == [(-60, 0.0), (0, 20 / 120), (120, 5 / 120), (60, 25 / 120)]


def test_lineage_of_many_renames_and_no_job_while_planning(spark, rows):
    log = [event(1, "ADD_PARTITION", "n0", "p=0", payload=0)]
    for k in range(12):
        log.append(event(10 * k + 5, "ALTER_TABLE", f"n{k}", to=f"n{k + 1}"))
        log.append(event(10 * k + 6, "ADD_PARTITION", f"n{k + 1}", f"p={k + 1}", payload=k + 1))
    log += [event(500, "ADD_PARTITION", "n3", "p=late", payload=9), event(501, "DROP_TABLE", "n3"), event(502, "ADD_PARTITION", "n3", "p=new", payload=8)]
    df = spark.createDataFrame([tuple(e.values()) for e in log], "event_id long, event_type string, table_name string, part_name string, renamed_to string, payload long")
    spark.sparkContext.setJobGroup("planning", "planning")
    state = catalog_log.catalog_state(catalog_log.object_changes(df))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("reading", "reading")
    got = [r for r in rows(state, "table_name", "part_name", "payload") if r[1]]
    assert got == sorted([("n12", f"p={k}", k) for k in range(13)] + [("n3", "p=new", 8)])
    lineage = catalog_log.table_lineage(catalog_log.object_changes(df).filter("change = 'delete' and part_name = ''"))
    assert {tuple(r) for r in lineage.collect()} == {*((10 * k + 5, "n12") for k in range(12)), (501, None)}

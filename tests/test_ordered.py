"""Running values and packing against brute force, with blocks far smaller than a key."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import ordered, packing
from strandline.session import block_of


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 300), ("warm", 40), ("one", 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 2, 9])
            rows.append((key, at, rng.choice([None, rng.randint(-5, 20)])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, at long, v long")


def by_key(rows):
    out = {}
    for k, at, v in sorted(rows):
        out.setdefault(k, []).append((at, v))
    return out


def test_running_sum_min_last(data, rows):
    raw, df = data
    values = {"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "latest": ("last", F.col("v")), "n": ("count", F.lit(1))}
    out = ordered.running(df, ["k"], ["at"], block_of(F.col("at"), 16), values)
    got = {(r["k"], r["at"]): (r["total"], r["low"], r["latest"], r["n"]) for r in out.collect()}
    for k, seq in by_key(raw).items():
        seen, latest = [], None
        for i, (at, v) in enumerate(seq):
            if v is not None:
                seen.append(v)
                latest = v
            want = (sum(seen) if seen else None, min(seen) if seen else None, latest, i + 1)
            assert got[(k, at)] == want


def test_null_keys_belong_together(spark, rows):
    df = spark.createDataFrame([(None, i, "a") for i in range(6)] + [(1, i, None) for i in range(6)], "k long, at long, j string")
    for width in (2, 3, 100):
        got = ordered.numbered(df, ["k", "j"], ["at"], block_of(F.col("at"), width), "n")
        assert [(r["k"], r["at"], r["n"]) for r in got.orderBy(F.col("k").asc_nulls_first(), "at").collect()] == [
            (k, i, i + 1) for k in (None, 1) for i in range(6)
        ]


def test_running_backwards_and_exclusive(data):
    raw, df = data
    out = ordered.running(
        df, ["k"], ["at"], block_of(F.col("at"), 16), {"low": ("min", F.col("v"))}, descending=True, inclusive=False
    )
    got = {(r["k"], r["at"]): r["low"] for r in out.collect()}
    for k, seq in by_key(raw).items():
        for i, (at, _) in enumerate(seq):
            later = [v for _, v in seq[i + 1 :] if v is not None]
            assert got[(k, at)] == (min(later) if later else None)


@pytest.mark.parametrize("following", [False, True])
def test_neighbours_keep_missing_values(data, following):
    raw, df = data
    out = ordered.neighbour(df, ["k"], ["at"], block_of(F.col("at"), 8), {"other": F.col("v")}, following=following)
    got = {(r["k"], r["at"]): r["other"] for r in out.collect()}
    for k, seq in by_key(raw).items():
        for i, (at, _) in enumerate(seq):
            j = i + 1 if following else i - 1
            assert got[(k, at)] == (seq[j][1] if 0 <= j < len(seq) else None)


def greedy(sizes, max_rows, max_bytes, full_at):
    numbers, no, count, held = [], 0, 0, 0
    for size in sizes:
        if full_at:
            if no == 0 or count >= max_rows or held >= max_bytes:
                no, count, held = no + 1, 0, 0
        elif no == 0 or count >= max_rows or held + size > max_bytes:
            no, count, held = no + 1, 0, 0
        count, held = count + 1, held + size
        numbers.append(no)
    return numbers


@pytest.mark.parametrize("full_at", [False, True])
@pytest.mark.parametrize("max_rows,max_bytes,width", [(3, 40, 4), (7, 60, 7), (5, 10_000, 16), (4, 0, 8)])
def test_packing_is_greedy(spark, monkeypatch, full_at, max_rows, max_bytes, width):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(max_rows * 100 + width)
    rows = []
    for key, n in (("hot", 230), ("tiny", 2), ("mid", 33)):
        rows += [(key, 5 * i + rng.randint(0, 4), rng.choice([0, 1, 9, 15, 30, 90])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, size long")
    out = packing.pack(df, ["k"], "at", "size", max_rows=max_rows, max_bytes=max_bytes, full_at=full_at, width=width)
    got = {(r["k"], r["at"]): r["batch_no"] for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((at, size) for k, at, size in rows if k == key)
        want = greedy([s for _, s in mine], max_rows, max_bytes, full_at)
        assert [got[(key, at)] for at, _ in mine] == want


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, v int")
    assert rows(ordered.first_per_key(df, ["k"], [F.desc("v")], 2)) == [("a", 2), ("a", 3), ("b", 9)]


def test_a_hot_key_is_spread(spark):
    """A third of the rows has one key; no task of the window gets more than its share of blocks."""
    df = spark.range(60_000).select(
        F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.running(df, ["k"], ["at"], block_of(F.col("at"), 500), {"n": ("count", F.lit(1))})
        sizes = [r["c"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("n").alias("c")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 60_000 and max(sizes) < 60_000 / 8 * 1.6
    assert out.filter("k = 0").agg(F.max("n")).first()[0] == 20_000 + 8


@pytest.mark.parametrize("following", [False, True])
def test_without_keys_summaries_are_carried_in_two_levels(spark, monkeypatch, following):
    monkeypatch.setattr(ordered, "UPPER_BLOCK", 3)
    rng = random.Random(1)
    ids = sorted(rng.sample(range(2000), 300))
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in ids], "at long, v long").repartition(4)
    out = ordered.neighbour(df, [], ["at"], block_of(F.col("at"), 16), {"other": F.col("v")}, following=following)
    got = {r["at"]: r["other"] for r in out.collect()}
    values = [None if i % 5 == 0 else i for i in ids]
    expected = [*values[1:], None] if following else [None, *values[:-1]]
    assert [got[i] for i in ids] == expected
    sums = ordered.running(df, [], ["at"], block_of(F.col("at"), 16), {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, descending=following)
    order = ids[::-1] if following else ids
    seen = {r["at"]: (r["n"], r["s"]) for r in sums.collect()}
    total = 0
    for k, i in enumerate(order):
        total += 0 if i % 5 == 0 else i
        assert seen[i] == (k + 1, total or None)

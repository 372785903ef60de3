"""Nearest neighbours against brute force: recall of the forest, exact ranks and distances, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import neighbours

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def by_hand(rows, asked, k=10):
    """Rows (id, vector): nearest other ids of each asked id; an id counts by its nearest vector."""
    out = {}
    for q, v in rows:
        if asked(q):
            for i, w in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum()))
                    out.setdefault(q, {})
                    out[q][i] = min(d, out[q].get(i, np.inf))
    return {q: [(i, d) for d, i in sorted((d, i) for i, d in found.items())[:k]] for q, found in out.items()}


def listed(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(found, expected):
    assert found.keys() == expected.keys()
    for q, pairs in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in pairs]
        assert np.allclose([d for _, d in found[q]], [d for _, d in pairs], rtol=1e-12, atol=0)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_recall_on_the_given_tables(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    expected = by_hand(rows, lambda q: q % 100 == 0)
    found = listed(neighbours.neighbours(frame, F.col("vec_id") % 100 == 0))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in pairs}) for q, pairs in expected.items())
    assert found.keys() == expected.keys() and hits >= 0.9 * sum(map(len, expected.values()))


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, dim))
    return rng.normal(size=(n, 4)) @ base + 0.01 * rng.normal(size=(n, dim))


def test_deep_trees_small_blocks_and_a_hot_vector(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("BLOCK", 20), ("LEAF", 4)):
        monkeypatch.setattr(neighbours, name, value)
    matrix = clustered(1200, 12, 3).astype(np.float32)
    matrix[400:800] = matrix[400]  # a third of all rows
    rows = [(k, row.tolist()) for k, row in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    expected = by_hand(rows, lambda q: q % 20 == 0)
    found = listed(neighbours.neighbours(frame, F.col("vec_id") % 20 == 0, trees=3))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in pairs}) for q, pairs in expected.items())
    assert found.keys() == expected.keys() and hits >= 0.9 * sum(map(len, expected.values()))
    for q in range(400, 800, 20):
        assert found[q] == [(i, 0.0) for i in range(400, 412) if i != q][:10]


def test_forest_visits_every_leaf_once_and_nearest_first():
    sample = clustered(512, 8, 1)
    forest = neighbours.Forest(sample, trees=3, leaf=16)
    forest.calibrate(sample, 0.9, 10, 8 * neighbours.LEAF_ROWS)
    assert forest.depth == 4
    margins = forest.margins(sample[:20])
    own = forest.leaf_of(sample[:20])
    for i in range(20):
        seen = list(forest.visits(margins[i]))
        assert sorted(seen) == list(range(48)) and set(seen[:3]) == set(own[i].tolist())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 2.0]), (100, [5.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]),
        (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 0.0]), (200, [0.0, 0.0]), (11, [3.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("code", "leaf", "block", "print", "vector", "score", "rank", "query_id"):
        frame = frame.withColumn(name, F.lit(1))
    expected = by_hand([(i, v) for i, v in rows if i in (0, 1, 2, 3, 11, 100)], lambda q: q % 100 == 0)
    same(listed(neighbours.neighbours(frame, F.col("vec_id") % 100 == 0)), expected)
    assert neighbours.neighbours(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.neighbours(frame.where("vec_id in (4, 5, 10)"), F.lit(True)).count() == 0
    assert neighbours.neighbours(frame.where("vec_id = 0"), F.lit(True)).count() == 0
    whole = frame.withColumn("embedding", F.col("embedding").cast("array<decimal(10,2)>")).where("vec_id in (0, 1, 2)")
    same(listed(neighbours.neighbours(whole, F.col("vec_id") == 0)), by_hand([(0, [1, 0]), (1, [1, 0]), (2, [0, 1])], lambda q: q == 0))


def test_ties_go_to_the_smaller_id():
    rows = np.array([[1.0, 0], [0, 1], [-1, 0], [0, -1], [2, 0]])
    q, ids, distance = neighbours.nearest_of(np.zeros((1, 2)), rows, np.array([9, 7, 8, 3, 1]), 3)
    assert q.tolist() == [0, 0, 0] and ids.tolist() == [3, 7, 8] and distance.tolist() == [1, 1, 1]

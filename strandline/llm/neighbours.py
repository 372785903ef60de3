"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits at the median of the projection
on the difference of two random sample points. Every row goes to its leaf in every tree. A
query walks down all trees through one priority queue, nearest split first, and visits
leaves until they hold a share of all rows. Queries then meet the rows of their leaves, in
blocks of bounded size, and are reranked with exact distances.

That share is calibrated on the sample: the smallest one that finds ``recall`` of the
neighbours that sample rows have in the sample. Vectors without any structure, spread over
all directions alike, need most of the rows; those of low inner dimension a small part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.tables import settled

NEAREST = 10
#: Rows that the forest is fitted on (expected number; a hash of the id picks them), and how
#: many of them try the search out.
SAMPLE, TRIALS = 32_768, 192
#: Trees; least sample rows of a leaf and rows of one aimed at; rows of a block that queries are compared with.
TREES, LEAF, LEAF_ROWS, BLOCK = 2, 16, 1024, 16_384
#: Share of the true neighbours in the sample that the calibrated search must find.
RECALL = 0.95
SEED = 20


class Forest:
    """Perfect binary trees over one sample; a depth below the full one uses their upper part."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.full = max(0, int(np.log2(max(1, len(sample) / leaf))))
        self.depth = self.full
        self.planes = np.zeros((trees, (1 << self.full) - 1, self.dim))
        self.offsets = np.zeros((trees, (1 << self.full) - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(self.full):
                order = np.argsort(node, kind="stable")
                edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
                right = np.zeros(len(sample), np.int64)
                for k in range(1 << level):
                    own = order[edges[k] : edges[k + 1]]
                    if not len(own):
                        continue
                    a, b = sample[rng.choice(own, 2)]
                    length = np.linalg.norm(a - b)
                    plane = (a - b) / length if length > 0 else self._any(rng)
                    seen = sample[own] @ plane
                    middle = np.median(seen)
                    at = (1 << level) - 1 + k
                    self.planes[t, at], self.offsets[t, at] = plane, middle
                    right[own] = seen > middle
                node = 2 * node + right

    def _any(self, rng: np.random.Generator) -> np.ndarray:
        plane = rng.normal(size=self.dim)
        return plane / np.linalg.norm(plane)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, (rows, trees); leaves of tree t start at t * leaves."""
        out = np.zeros((len(rows), len(self.planes)), np.int64)
        for t, (planes, offsets) in enumerate(zip(self.planes, self.offsets)):
            node = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (np.einsum("ij,ij->i", rows, planes[at]) > offsets[at])
            out[:, t] = t * self.leaves + node
        return out

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Distance of every row to every split, (rows, trees, nodes)."""
        n = self.leaves - 1
        return np.einsum("ij,tkj->itk", rows, self.planes[:, :n]) - self.offsets[:, :n]

    def visits(self, margins: np.ndarray) -> Iterator[int]:
        """Leaves in the order of one queue for all trees: the smallest of the largest margins on the way first."""
        queue = [(0.0, t, 0, 0) for t in range(len(margins))]
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = margins[t][(1 << level) - 1 + node]
                side = int(margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, level + 1, 2 * node + 1 - side))
                node, level = 2 * node + side, level + 1
            yield t * self.leaves + node

    def calibrate(self, sample: np.ndarray, recall: float, nearest: int, rows: int, seed: int = SEED) -> float:
        """Set the depth by ``rows`` and return the share of all rows (trees add up) whose visit finds ``recall`` of the sample's neighbours."""
        self.depth = min(self.full, max(0, (rows // LEAF_ROWS).bit_length()))
        if len(sample) <= nearest + 1:
            return float(len(self.planes))
        trials = np.random.default_rng(seed).choice(len(sample), min(TRIALS, len(sample)), replace=False)
        d = (sample[trials] ** 2).sum(1)[:, None] + (sample**2).sum(1) - 2 * sample[trials] @ sample.T
        d[np.arange(len(trials)), trials] = np.inf
        best = np.argpartition(d, nearest - 1, 1)[:, :nearest]
        size = np.bincount(self.leaf_of(sample).ravel(), minlength=self.leaves * len(self.planes)) / len(sample)
        homes = self.leaf_of(sample[best.ravel()]).reshape(len(trials), nearest, -1)
        margins = self.margins(sample[trials])
        needed = []
        for i in range(len(trials)):
            share, at = 0.0, np.zeros(len(size))
            for leaf in self.visits(margins[i]):
                share += size[leaf]
                at[leaf] = share
            needed.append(at[homes[i]].min(1))
        return float(np.quantile(np.concatenate(needed), recall))


def _valid(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(rows: np.ndarray) -> pa.Array:
    """Vectors as binary: no length and null bits for each of their numbers in a shuffle."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


_KIND = {"float": np.float32, "double": np.float64}
_ROW = "leaf int, block int, is_query boolean, id long, code long, vector binary"


def _index(forest: Forest, blocks: np.ndarray, dim: int):
    """Every row once per tree, in a block of its leaf."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(2), dim)
            ids, codes = batch.column(0), batch.column(1)
            dealt = codes.to_numpy().view(np.uint64) >> np.uint64(20)
            leaves = forest.leaf_of(rows.astype(np.float64))
            packed = _packed(rows)
            for t in range(leaves.shape[1]):
                leaf = leaves[:, t]
                block = (dealt % blocks[leaf].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(block), pa.array(np.zeros(len(leaf), bool)), ids, codes, packed],
                    ["leaf", "block", "is_query", "id", "code", "vector"],
                )

    return index


def _visit(forest: Forest, counts: np.ndarray, blocks: np.ndarray, rows: int, share: float, least: int, dim: int):
    """Every query once per block of the leaves that it visits."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            matrix = _matrix(batch.column(1), dim)
            for k in range(0, len(codes), 256):
                part = matrix[k : k + 256]
                margins = forest.margins(part.astype(np.float64))
                who: list[int] = []
                leaf: list[int] = []
                for i in range(len(part)):
                    seen = 0
                    for at in forest.visits(margins[i]):
                        who.append(k + i)
                        leaf.append(at)
                        seen += int(counts[at])
                        if seen >= share * rows and seen >= least:
                            break
                leaf_no, index = np.array(leaf, np.int64), np.array(who, np.int64)
                times = blocks[leaf_no]
                leaf_no, index = np.repeat(leaf_no, times), np.repeat(index, times)
                block = np.arange(len(leaf_no)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(leaf_no), 10_000):
                    cut = slice(a, a + 10_000)
                    own = codes[index[cut]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(leaf_no[cut].astype(np.int32)), pa.array(block[cut].astype(np.int32)), pa.array(np.ones(len(own), bool)),
                            pa.array(np.zeros(len(own), np.int64)), pa.array(own), _packed(matrix[index[cut]]),
                        ],
                        ["leaf", "block", "is_query", "id", "code", "vector"],
                    )

    return visit


def nearest_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of each query, exact distances, ties to the smaller id.

    A product of matrices rules rows out with a margin far above its rounding error; the
    distances of what is left are sums of squared differences.
    """
    size = (rows**2).sum(1)
    own = (queries**2).sum(1)
    rough = own[:, None] + size - 2 * queries @ rows.T
    reach = np.partition(rough, k - 1, 1)[:, k - 1] if len(rows) > k else np.full(len(queries), np.inf)
    q, r = np.nonzero(rough <= (reach + 1e-9 * (own + size.max()))[:, None])
    distance = np.sqrt(((queries[q] - rows[r]) ** 2).sum(1))
    order = np.lexsort((ids[r], distance, q))
    q, r, distance = q[order], r[order], distance[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    first = place < k
    return q[first], ids[r[first]], distance[first]


def _rerank(kind: type, dim: int, k: int):
    """Blocks arrive in order, rows before queries: one block is held at a time, queries stream past it."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            leaf, block, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            ids, codes = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            vectors = np.frombuffer(b"".join(batch.column(5).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            change = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(leaf)]):
                if a == b:
                    continue
                if key != (leaf[a], block[a]):
                    key, held = (leaf[a], block[a]), []
                if not is_query[a]:
                    held.append((ids[a:b], vectors[a:b]))
                    continue
                if not held:
                    continue
                held = [tuple(np.concatenate(x) for x in zip(*held))]
                for s in range(a, b, 128):
                    e = min(s + 128, b)
                    q, found, distance = nearest_of(vectors[s:e], held[0][1], held[0][0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(codes[s:e][q]), pa.array(found), pa.array(distance)], ["code", "vec_id", "score"])

    return rerank


def neighbours(
    vectors: DataFrame, queries: Column, nearest: int = NEAREST, trees: int = TREES, sample: int = SAMPLE,
    recall: float = RECALL, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` rows found for each row that ``queries`` (a condition on vec_id) holds for.

    Euclidean distance in double precision on the given vectors, ties to the smaller
    ``vec_id``; the rows of a query's own id are no candidates. Vectors that are null, zero
    or hold null, NaN or infinite numbers take no part, nor do rows without an id and
    vectors of another length than most (ties: the longer). An id with several vectors
    counts by the nearest of them; repeated rows count once. Fewer candidates than
    ``nearest`` are all returned; an empty table gives none. Other columns are ignored.

    The forest is fitted on about ``sample`` rows; every row is indexed. Of equal vectors
    only the ``nearest`` + 1 smallest ids can be among the nearest of any query, so the
    others are left out before the search and equal queries are searched once.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where("vec_id IS NOT NULL")
    element = given.schema["vector"].dataType.elementType.simpleString()
    if element not in _KIND:
        given, element = given.withColumn("vector", F.col("vector").cast("array<double>")), "double"
    kind, schema = _KIND[element], "query_id long, rank int, vec_id long, score double"
    lengths = given.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count()
    longest = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    if longest is None:
        return spark.createDataFrame([], schema)
    dim = longest.dim
    # two hashes of 64 bits name a vector
    usable = given.where(_valid(F.col("vector"), dim)).withColumn("code", F.xxhash64("vector")).withColumn("print", F.xxhash64(F.lit(seed), F.reverse("vector")))
    alike = Window.partitionBy("code", "print").orderBy("vec_id")
    ids = usable.select("code", "print", "vec_id").distinct()
    hot = ids.withColumn("n", F.row_number().over(alike)).where(F.col("n") == nearest + 1).select("code", "print", F.col("vec_id").alias("last"))
    kept = settled(usable.join(hot, ["code", "print"], "left").where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last"))).drop("last", "print"), "vectors")
    rows = kept.count()
    if not rows:
        return spark.createDataFrame([], schema)

    picked = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / rows) * (1 << 30)) + 1)
    drawn = kept.where(picked).orderBy("vec_id", "code").select("vector").toArrow()
    points = _matrix(drawn.column(0).combine_chunks(), dim).astype(np.float64)
    forest = Forest(points, trees, seed=seed)
    share = forest.calibrate(points, recall, nearest, rows) if len(points) else float(trees)
    shared = spark.sparkContext.broadcast(forest)
    cells = trees * forest.leaves

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            counts += np.bincount(shared.value.leaf_of(_matrix(batch.column(0), dim).astype(np.float64)).ravel(), minlength=cells)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["leaf", "n"])

    counts = np.zeros(cells, np.int64)
    for r in kept.select("vector").mapInArrow(leaf_counts, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.leaf] = r.n  # one row a leaf: bounded by the sample
    blocks = np.maximum(1, -(-counts // BLOCK))

    asked = usable.where(queries).select(F.col("vec_id").alias("query_id"), "code", "vector")
    different = asked.groupBy("code").agg(F.first("vector").alias("vector"))
    index = lambda batches: _index(shared.value, blocks, dim)(batches)
    visit = lambda batches: _visit(shared.value, counts, blocks, rows, share, trees * (nearest + 1), dim)(batches)
    met = kept.select("vec_id", "code", "vector").mapInArrow(index, _ROW).unionAll(different.select("code", "vector").mapInArrow(visit, _ROW))
    parted = met.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "is_query")
    found = parted.mapInArrow(_rerank(kind, dim, nearest + 1), "code long, vec_id long, score double")
    # one id more than asked for: the query's own is taken out afterwards
    once = found.groupBy("code", "vec_id").agg(F.min("score").alias("score"))
    order = lambda key: Window.partitionBy(key).orderBy("score", "vec_id")
    best = once.withColumn("place", F.row_number().over(order("code"))).where(F.col("place") <= nearest + 1).drop("place")
    pairs = asked.select("query_id", "code").distinct().join(best, "code").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

"""Greedy packing of an ordered log into batches, exact and spread over many tasks.

A batch is closed by what it already holds, so where the next one starts depends
on where this one did.  The rows are numbered per key and cut into blocks of
``width`` rows.  From any start inside a block the place where its chain of
batches enters the next block is known from the block alone (plus the few rows a
batch can reach over).  So each block becomes a small map "entry -> exit"; the maps
are composed in a tree, the real entry of every block is looked up on the way back
down, and each block then marks its batch starts.  No task holds more than one
block, or ``FAN_IN`` maps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.ordered import numbered, running
from strandline.session import block_of, scratch_root

FAN_IN = 512
LEVELS = 2


def _next_start(sizes: np.ndarray, max_rows: int, max_bytes: int, full_at: bool) -> np.ndarray:
    """Start of the following batch, for a batch starting at each row."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(n)
    if full_at:  # closed once it holds max_bytes
        by_bytes = np.searchsorted(total, total[:-1] + max_bytes, side="left")
    else:  # closed before it would hold more than max_bytes
        by_bytes = np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1
    return np.minimum(np.maximum(at + 1, np.minimum(by_bytes, at + max_rows)), n)


def pack(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    size: str,
    *,
    max_rows: int,
    max_bytes: int,
    full_at: bool = False,
    block: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """Add ``batch_no`` (from 1) to the rows of each key along a unique integer ``order``.

    ``full_at=False``: a batch takes a row unless it has ``max_rows`` rows or would
    exceed ``max_bytes``; an oversized row stands alone.  ``full_at=True``: a batch
    is closed by the row that brings it to ``max_rows`` rows or ``max_bytes``.
    """
    keys = list(keys)
    scratch_root(df.sparkSession)
    width = max(width or 4 * max_rows, max_rows)
    order_block = block_of(F.col(order)) if block is None else block
    numbered_rows = numbered(df, keys, [order], order_block, "__n")
    placed = numbered_rows.withColumn("__pos", F.col("__n") - 1).drop("__n").checkpoint()

    blk = F.floor(F.col("__pos") / width).cast("long")
    reach = F.when(
        (F.col("__pos") % width < max_rows) & (blk > 0), F.array(blk, blk - 1)
    ).otherwise(F.array(blk))
    cells = placed.select(*keys, "__pos", F.col(size).cast("long").alias("__size"), F.explode(reach).alias("__b0"))

    key_fields = [f for f in df.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))

    def rows_of(pdf: pd.DataFrame):
        pdf = pdf.sort_values("__pos")
        at = (pdf["__pos"] - pdf["__b0"].iloc[0] * width).to_numpy()
        return at, _next_start(pdf["__size"].to_numpy(), max_rows, max_bytes, full_at)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        at, nxt = rows_of(pdf)
        own = int((at < width).sum())
        goes = np.concatenate([nxt[:own], np.arange(own, len(at) + 1)])
        while (goes[:own] < own).any():
            goes[:own] = goes[goes[:own]]
        out = np.full(max_rows, -1, dtype=np.int64)
        reached = min(max_rows, own)
        out[:reached] = goes[:reached] - own if own == width else -1
        # the last block of a key has fewer rows, and no block follows it
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "__b0": [pdf["__b0"].iloc[0]], "__map": [out.tolist()]})

    map_type = T.ArrayType(T.LongType())
    b_field = lambda i: T.StructField(f"__b{i}", T.LongType())
    map_schema = lambda i: T.StructType([*key_fields, b_field(i), T.StructField("__map", map_type)])
    levels = [cells.groupBy(*keys, "__b0").applyInPandas(exits, map_schema(0)).checkpoint()]

    def composer(i: int):
        def compose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(f"__b{i}")
            through = np.arange(max_rows)
            for step in pdf["__map"]:
                step = np.asarray(step)
                through = np.where(through >= 0, step[np.maximum(through, 0)], -1)
            row = {k: [pdf[k].iloc[0]] for k in keys}
            return pd.DataFrame({**row, f"__b{i + 1}": [pdf[f"__b{i}"].iloc[0] // FAN_IN], "__map": [through.tolist()]})

        return compose

    for i in range(LEVELS):
        up = levels[i].withColumn("__up", F.floor(F.col(f"__b{i}") / FAN_IN))
        levels.append(up.groupBy(*keys, "__up").applyInPandas(composer(i), map_schema(i + 1)).checkpoint())

    def walker(i: int):
        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(f"__b{i}")
            entry, entries = int(pdf["__entry"].iloc[0]), []
            for step in pdf["__map"]:
                entries.append(entry)
                entry = int(step[entry]) if entry >= 0 else -1
            return pdf[[*keys, f"__b{i}"]].assign(__entry=np.array(entries, dtype=np.int64))

        return walk

    entry_schema = lambda i: T.StructType([*key_fields, b_field(i), T.StructField("__entry", T.LongType())])
    entries = (
        levels[LEVELS].withColumn("__entry", F.lit(0).cast("long"))
        .groupBy(*keys).applyInPandas(walker(LEVELS), entry_schema(LEVELS))
    )
    for i in reversed(range(LEVELS)):
        up = f"__b{i + 1}"
        children = levels[i].withColumn(up, F.floor(F.col(f"__b{i}") / FAN_IN).cast("long"))
        entries = (
            children.join(entries, [*keys, up]).groupBy(*keys, up).applyInPandas(walker(i), entry_schema(i))
        )

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        at, nxt = rows_of(pdf)
        own = int((at < width).sum())
        starts = np.zeros(own, dtype=np.int32)
        i = int(pdf["__entry"].iloc[0])
        while 0 <= i < own:
            starts[i] = 1
            i = int(nxt[i])
        pdf = pdf.sort_values("__pos").head(own)
        return pdf[[*keys, "__pos"]].assign(__start=starts)

    mark_schema = T.StructType(
        [*key_fields, T.StructField("__pos", T.LongType()), T.StructField("__start", T.IntegerType())]
    )
    marked = cells.join(entries, [*keys, "__b0"]).groupBy(*keys, "__b0").applyInPandas(mark, mark_schema)
    flagged = placed.join(marked, [*keys, "__pos"])
    out = running(flagged, keys, ["__pos"], block_of(F.col("__pos")), {"batch_no": ("sum", F.col("__start"))})
    return out.select(*df.columns, "batch_no")


def split_batches(records: DataFrame, keys: Sequence[str], order: str, size: str, max_n: int, max_bytes: int, **kw) -> DataFrame:
    """Send batches of a stream partition: at most ``max_n`` records and ``max_bytes``."""
    return pack(records, keys, order, size, max_rows=max_n, max_bytes=max_bytes, **kw)


def plan_bundles(
    files: DataFrame, keys: Sequence[str], order: str, threshold: int, target_bytes: int, max_files: int, **kw
) -> DataFrame:
    """Copy tasks of a listing: large files alone (``bundle_no`` NULL), small ones in bundles."""
    if threshold <= 0:
        return files.withColumn("bundle_no", F.lit(None).cast("long"))
    small = pack(
        files.filter(F.col("size") < threshold), keys, order, "size",
        max_rows=max_files, max_bytes=target_bytes, full_at=True, **kw,
    )
    large = files.filter(~(F.col("size") < threshold)).withColumn("batch_no", F.lit(None).cast("long"))
    return small.unionByName(large).withColumnRenamed("batch_no", "bundle_no")

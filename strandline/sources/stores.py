"""Paths of any file system, and lists of files dealt out to tasks by number or by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of files that one task is meant to read.
TASK_BYTES = 128 << 20


def canonical(path: str) -> str:
    """One spelling of a path: local ones without a scheme, others as the URI they are; no slash at the end."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path.rstrip("/") or "/"


def canonical_path(path: Column) -> Column:
    """``canonical`` as a column expression."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "(?<=.)/+$", "")


def child(folder: str, name: str) -> str:
    """A name below a folder, as the folder is spelled: file systems give paths back without scheme and host."""
    return folder.rstrip("/") + "/" + name


def open_store(path: str):
    """The Arrow file system of a path or URI and the path on it."""
    from pyarrow import fs

    path = canonical(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def dealt_by_number(df: DataFrame, column: str, rows: int, per_task: int) -> DataFrame:
    """Rows dealt to tasks of about ``per_task``, but to as many tasks as run at once where there are few.

    The number is given, so adaptive execution does not put small rows that stand for
    long work back into one task.
    """
    at_once = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(rows, max(at_once, -(-rows // per_task))))
    return df.repartitionById(tasks, F.pmod(F.xxhash64(column), F.lit(tasks)).cast("int"))


def dealt_by_bytes(files: DataFrame, column: str, size: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files packed into tasks by their bytes.

    Files of one class (sizes within a factor of two) go to as many bins as the bytes of
    the class fill, so large files stand alone and thousands of small ones share a task. Only
    the sums of the classes, 64 rows at most, come to the driver.
    """
    step = F.when(F.coalesce(size, F.lit(0)) > 0, F.floor(F.log2(F.col(size).cast("double")))).otherwise(-1).cast("int")
    classed = files.withColumn("__class", step)
    sums = classed.groupBy("__class").agg(F.sum(F.coalesce(size, F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    whole = sum(r.bytes for r in sums)
    at_once = files.sparkSession.sparkContext.defaultParallelism
    # with little to do in all, it is still spread over the tasks that run at once
    task_bytes = max(1, min(task_bytes, -(-whole // at_once)))
    bins = {r["__class"]: max(1, min(r.n, -(-r.bytes // task_bytes))) for r in sums}
    first, total = {}, 0
    for name in sorted(bins):
        first[name], total = total, total + bins[name]
    if not total:
        return files
    lookup = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("__class"))
    place = lookup(first) + F.pmod(F.xxhash64(column), lookup(bins))
    return classed.repartitionById(total, place.cast("int")).drop("__class")

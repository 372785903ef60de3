"""Running a stream to the end of its input, and tables that a stream keeps up to date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.ordered import first_per_key
from strandline.session import scratch_path


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows with the updated keys replaced and the new ones added; safe to repeat.

    NULL keys match each other.
    """
    old, new = target.alias("old"), updates.select(*keys).alias("new")
    same = [F.col(f"old.`{k}`").eqNullSafe(F.col(f"new.`{k}`")) for k in keys]
    return updates.select(*target.columns).unionByName(old.join(new, same, "left_anti"))


class StateTable:
    """A small table (positions, attempts) rewritten once per micro-batch, in two slots.

    Batch ``n`` reads the slot of ``n - 1`` and overwrites its own, so a batch that
    is run again after a failure starts from the same state and ends in the same one.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType | str, path: str):
        self.spark = spark
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.path = path

    def _slot(self, epoch: int) -> str:
        return f"{self.path}/slot-{epoch % 2}"

    def before(self, epoch: int) -> DataFrame:
        if epoch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._slot(epoch - 1))

    def write(self, epoch: int, df: DataFrame) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._slot(epoch))

    def after(self, epoch: int) -> DataFrame:
        return self.before(epoch + 1)

    def commit(self, epoch: int) -> None:
        """Record that the state of a micro-batch is complete."""
        commit_epoch(self.spark, self.path, epoch)

    def latest(self) -> DataFrame:
        """State after the last complete micro-batch, of whichever run."""
        last = last_commit(self.spark, self.path)
        return self.after(-1 if last is None else last)


def fold_stream(stream: DataFrame, table: StateTable, fold: Callable[[DataFrame, DataFrame, int], DataFrame], *,
                mode: str = "append") -> DataFrame:
    """Apply ``fold(state, batch, epoch) -> state`` to every micro-batch; the state at the end.

    A call with the path of an earlier one goes on after its last complete micro-batch.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        table.write(epoch, fold(table.before(epoch), batch, epoch))
        table.commit(epoch)

    drain(stream.writeStream.outputMode(mode).foreachBatch(step), table.path)
    return table.latest()


COMMIT_SCHEMA = T.StructType([T.StructField("rows", T.LongType()), T.StructField("high", T.LongType()), T.StructField("epoch", T.LongType())])


def commit_epoch(spark: SparkSession, path: str, epoch: int, rows: int | None = None, high: int | None = None) -> None:
    """One record per micro-batch, written after everything else of it; written again if the batch is run again."""
    record = spark.createDataFrame([(rows, high)], T.StructType(COMMIT_SCHEMA.fields[:2]))
    record.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/epoch={epoch}")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit records (rows, high, epoch) below a path; none before the first."""
    return _read_or_none(spark, COMMIT_SCHEMA, f"{path}/commits")


def _read_or_none(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_commit(spark: SparkSession, path: str) -> int | None:
    return commits(spark, path).agg(F.max("epoch")).first()[0]


def committed_position(spark: SparkSession, path: str) -> int | None:
    """Greatest ``high`` of the complete micro-batches: where a reader outside of the stream goes on."""
    return commits(spark, path).agg(F.max("high")).first()[0]


def resumable(
    stream: DataFrame, path: str, fn: Callable[[DataFrame], DataFrame] | None = None, *, high: str | None = None, mode: str = "append"
) -> DataFrame:
    """Rows of ``fn(batch)`` of all micro-batches under a named path, with their ``epoch``.

    Offsets, rows and commit records live below ``path``. A call with the same path goes
    on where the last one ended, or failed: a batch that was cut off is run again and
    replaces its rows, and only rows of complete batches are read. ``high`` names a
    column whose greatest value goes into the commit record.
    """
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)
    schema = (empty if fn is None else fn(empty)).schema

    def step(batch: DataFrame, epoch: int) -> None:
        append_once(batch if fn is None else fn(batch), epoch, path)
        written = spark.read.schema(schema).parquet(f"{path}/rows/epoch={epoch}")
        top = F.max(high).cast("long") if high else F.lit(None).cast("long")
        commit_epoch(spark, path, epoch, *written.agg(F.count(F.lit(1)), top).first())

    drain(stream.writeStream.outputMode(mode).foreachBatch(step), path)
    return committed_rows(spark, schema, path)


def committed_rows(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Rows of the complete micro-batches below a path, with their ``epoch``."""
    if last_commit(spark, path) is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("epoch", T.LongType())]))
    return batch_rows(spark, schema, path).join(commits(spark, path).select("epoch"), "epoch", "left_semi")


def append_once(df: DataFrame, epoch: int, path: str) -> None:
    """Append the rows of a micro-batch; running the batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")


def batch_rows(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Everything ``append_once`` has written, with the ``epoch`` it came in; no rows before the first micro-batch."""
    with_epoch = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return _read_or_none(spark, with_epoch, f"{path}/rows")


def per_batch(
    stream: DataFrame, label: str, fn: Callable[[DataFrame], DataFrame] | None = None, *, mode: str = "append"
) -> DataFrame:
    """Rows of ``fn(batch)`` of every micro-batch, with their ``epoch``; each batch writes only its own rows."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, label)
    shape = {"schema": stream.schema}

    def step(batch: DataFrame, epoch: int) -> None:
        out = batch if fn is None else fn(batch)
        shape["schema"] = out.schema
        append_once(out, epoch, path)

    drain(stream.writeStream.outputMode(mode).foreachBatch(step), path)
    return batch_rows(spark, shape["schema"], path)


def keyed_result(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Result of a keyed streaming aggregate.

    A micro-batch appends the keys it changed and nothing else; the newest row of a
    key is taken when the result is read.
    """
    changes = per_batch(stream, label, mode="update")
    return first_per_key(changes, keys, [F.desc("epoch")]).drop("epoch")


def appended(stream: DataFrame, label: str) -> DataFrame:
    """Result of an append-mode stream, through a Parquet file sink."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/data")
    drain(writer, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def drain(writer, path: str) -> None:
    """Run to the end of what is there now, in as many micro-batches as the source makes."""
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

"""Record streams: replication, duplicates, lag and order of batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import display, wire
from strandline.operators.joins import map_schema_ids
from strandline.session import scratch_path
from strandline.streaming.tables import StateTable, append_once, batch_rows, drain


def read_topic(spark: SparkSession, servers: str, topics: Sequence[str], start: str = "LATEST", **options) -> DataFrame:
    """Topics as a stream of (topic, part, rec_offset, ts, key, value, headers)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("includeHeaders", True)
        .option("startingOffsets", start.lower()).options(**options)
    )
    return from_topic(reader.load())


def from_topic(raw: DataFrame) -> DataFrame:
    """Columns of the stream source under the names used here."""
    return raw.select(
        "topic", F.col("partition").alias("part"), F.col("offset").alias("rec_offset"),
        F.col("timestamp").alias("ts"), "key", "value", "headers",
    )


def to_topic(records: DataFrame, topic: str | None = None) -> DataFrame:
    """Columns of the stream sink.  It cannot set a record's time, so that goes into a header."""
    stamp = F.struct(
        F.lit("X-Source-Timestamp").alias("key"), F.encode(F.unix_millis("ts").cast("string"), "UTF-8").alias("value")
    )
    headers = F.concat(F.coalesce("headers", F.array().cast(wire.HEADERS_TYPE)), F.array(stamp))
    name = F.col("topic") if topic is None else F.lit(topic)
    return records.select(name.alias("topic"), F.col("part").alias("partition"), "key", "value", headers.alias("headers"))


def write_topic(records: DataFrame, servers: str, checkpoint: str, topic: str | None = None, **options):
    """Stream writer that keeps partition, key, headers and tombstones."""
    writer = to_topic(records, topic).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("checkpointLocation", checkpoint).options(**options)


def replicate(
    records: DataFrame, id_map: DataFrame, local: str, target: str | None, target_format: str = wire.CONFLUENT,
    configured: str = wire.AUTO_DETECT, max_hops: int = 3,
) -> DataFrame:
    """Records as they are written to the target site, tombstones included.

    Echoes are dropped, schema ids mapped by a stream-static join, payload headers
    rewritten and the record headers enriched.  ``id_missing`` marks records whose
    schema the target does not know; they keep their bytes.
    """
    kept = records.filter(wire.should_replicate(F.col("headers"), local, target, max_hops))
    kept = kept.withColumn("format", wire.classify_payload(F.col("value"), configured))
    mapped = map_schema_ids(kept.withColumn("source_id", wire.schema_id(F.col("value"), F.col("format"))), id_map)
    return mapped.withColumns(
        {
            "value": wire.transcode(F.col("value"), F.col("format"), target_format, F.col("target_id")),
            "headers": wire.enrich_headers(F.col("headers"), local),
            "is_tombstone": F.col("value").isNull(),
        }
    ).drop("source_id", "target_id")


def stream_lag(records: DataFrame, now_ms: int, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Largest lag in milliseconds per topic."""
    return records.groupBy(*by).agg(F.max(display.lag_ms(F.lit(now_ms), F.col("ts_ms"))).alias("lag_ms"))


def dedupe_records(stream: DataFrame, time: str, delay: str, keys: Sequence[str] = ("topic", "part", "rec_offset")) -> DataFrame:
    """First arrival of each record; repeats within ``delay`` are dropped.

    A row older than the watermark (the newest time seen less ``delay``) is dropped as
    late even if it is no repeat: choose ``delay`` longer than any lateness, or
    use ``dropDuplicates`` on the keys in a batch, which drops repeats only.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def accept_in_order(batches: DataFrame, accepted: DataFrame, key: str = "part") -> DataFrame:
    """Whether each batch of a micro-batch is accepted, in order of arrival (``seq``).

    A batch is accepted when it does not say what it continues, when nothing was
    accepted before, or when it continues the last accepted one; a rejected batch
    leaves the position alone.  ``accepted`` has (key, max_offset).  The rows of a
    key are sorted by Spark and read once as a stream of Arrow batches with one
    number kept per key, so nothing is gathered.
    """
    start = accepted.select(key, F.col("max_offset").alias("__start"))
    cols = [key, "seq", "prev_max", "max_offset"]
    joined = batches.select(*cols).join(start, key, "left")
    kind = dict(batches.dtypes)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, position = None, None
        for part in parts:
            verdicts = []
            for k, prev, top, begin in zip(part[key], part["prev_max"], part["max_offset"], part["__start"]):
                if k != current:
                    current, position = k, None if pd.isna(begin) else int(begin)
                ok = position is None or pd.isna(prev) or int(prev) == position
                position = int(top) if ok else position
                verdicts.append(ok)
            yield part[[key, "seq", "max_offset"]].assign(accepted=verdicts)

    ordered = joined.repartition(key).sortWithinPartitions(key, "seq")
    schema = f"{key} {kind[key]}, seq {kind['seq']}, max_offset {kind['max_offset']}, accepted boolean"
    return ordered.mapInPandas(walk, schema)


def last_accepted(verdicts: DataFrame, before: DataFrame, key: str = "part") -> DataFrame:
    """Accepted position of every key after a micro-batch."""
    now = verdicts.filter("accepted").groupBy(key).agg(F.max_by("max_offset", "seq").alias("max_offset"))
    return now.unionByName(before.select(key, "max_offset").join(now, key, "left_anti"))


def accept_stream(batches: DataFrame, label: str, key: str = "part") -> DataFrame:
    """``accept_in_order`` over a stream: the verdict of every batch, with its epoch.

    The verdicts of a micro-batch are written first and the positions after it are
    taken from them, so both agree however often the micro-batch is run.
    """
    spark, path = batches.sparkSession, scratch_path(batches.sparkSession, label)
    kind = dict(batches.dtypes)
    positions = StateTable(spark, f"{key} {kind[key]}, max_offset {kind['max_offset']}", f"{path}/positions")
    verdict_type = T.StructType.fromDDL(
        f"{key} {kind[key]}, seq {kind['seq']}, max_offset {kind['max_offset']}, accepted boolean"
    )

    def step(batch: DataFrame, epoch: int) -> None:
        before = positions.before(epoch)
        append_once(accept_in_order(batch, before, key), epoch, path)
        verdicts = batch_rows(spark, verdict_type, path).filter(F.col("epoch") == epoch)
        positions.write(epoch, last_accepted(verdicts, before, key))

    drain(batches.writeStream.foreachBatch(step), path)
    return batch_rows(spark, verdict_type, path)

"""Reading the given tables, writing intermediate ones, and native text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch_path

#: A word of the whitespace contracts: a run without ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: A word of the alphanumeric contracts, after lower-casing A-Z: digits, a-z and
#: everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Later jobs then start from files that every executor sees, so a lost executor
    costs its running tasks only, and Python passes are not repeated.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """Words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)), F.array().cast("array<string>"))


def n_plain_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1.

    A null id has no checksum; it counts as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per id; the larger one where an id is labelled twice."""
    return (
        labels.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("label"))
        .where("label_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
    )

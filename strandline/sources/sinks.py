"""Tables and exports written by Spark's own commit protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.ordered import first_per_key
from strandline.streaming.tables import upsert_by_key

# First characters a spreadsheet would read as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def save_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Write to a table of the catalog, at a given place when there is one."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def csv_cells(df: DataFrame, guard: bool = True) -> DataFrame:
    """Every column as text for a CSV cell; NULL is empty, formula starts get an apostrophe."""

    def cell(name: str):
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        safe = F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)
        return (safe if guard else text).alias(name)

    return df.select(*[cell(name) for name in df.columns])


def export_csv(df: DataFrame, path: str, guard: bool = True, header: bool = True) -> None:
    """CSV with every field quoted and quotes doubled."""
    writer = csv_cells(df, guard).write.mode("overwrite").option("header", header).option("quoteAll", True)
    writer.option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, missing values kept as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def overwrite_table_atomically(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a folder, or only the partitions there is data for.

    Files appear under their final names when the job commits; with partitions the
    others are left alone.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def upsert_partitions(target: DataFrame, updates: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Add partitions that are new, replace those that are there; repeating it changes nothing.

    Of several updates of a key the first in the order ``newest`` counts. NULL is a key like others.
    """
    return upsert_by_key(target, first_per_key(updates, keys, newest), keys)


def compact_small_files(spark: SparkSession, root: str, plan: DataFrame, out: str, key: str = "folder") -> None:
    """Rewrite the files of every bundle as one file, and carry all other files along.

    ``plan`` has (path, folder, bundle_no).  The rows of a bundle go to one task and
    are written there; a bundle is bounded by the plan, so no task gets more than
    that.  Files without a bundle, too large for one or not in the plan, are written as
    they are read, without a shuffle, under ``bundle_no`` -1 (no folder: empty).
    Spark percent-encodes the path of a row's file and a listing does not, so rows are
    matched on the decoded path without scheme.
    """
    encoded = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    rows = spark.read.option("recursiveFileLookup", True).parquet(root).withColumn("__path", _bare(F.url_decode(encoded)))
    placed = rows.join(
        plan.select(_bare(F.col("path")).alias("__path"), F.col(key).alias("__folder"), "bundle_no"), "__path", "left"
    ).drop("__path")
    bundled = placed.filter(F.col("bundle_no").isNotNull())
    bundled.repartition("__folder", "bundle_no").write.mode("overwrite").partitionBy("__folder", "bundle_no").parquet(out)
    alone = placed.filter(F.col("bundle_no").isNull())
    alone = alone.withColumn("bundle_no", F.lit(-1).cast(placed.schema["bundle_no"].dataType))
    alone.write.mode("append").partitionBy("__folder", "bundle_no").parquet(out)


def _bare(path: Column) -> Column:
    """A local path in one form, whether or not it comes with the scheme."""
    return F.regexp_replace(path, "^file:/+", "/")



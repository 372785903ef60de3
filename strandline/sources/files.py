"""Files, folders and catalogs as DataFrames."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.functions.display import fmt_size
from strandline.operators.windows import limit_with_flag
from strandline.session import scratch_root
from strandline.sources import stores
from strandline.sources.stores import child, open_store

# Rows shown by a preview.
PREVIEW_ROWS = 100
#: Folders listed and files opened by one task, where there are many.
FOLDERS_A_TASK, FILES_A_TASK = 256, 512


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a path by the extension of its name; anything without a reader is one row per file."""
    ext = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext in ("parquet", "parq"):
        return spark.read.options(**options).parquet(path)
    if ext == "orc":
        return spark.read.options(**options).orc(path)
    if ext in ("csv", "tsv"):
        return read_delimited(spark, path, **options)
    if ext in paths.TEXT_EXTENSIONS or len(ext) <= 4:
        return spark.read.options(**options).text(path)
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.concat(F.lit("binary file, no preview, "), fmt_size(F.col("length"))).alias("note")
    )


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, **options) -> DataFrame:
    """CSV or TSV with a header, all columns text, values trimmed, quoted separators kept."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
    return reader.option("ignoreTrailingWhiteSpace", True).options(**options).csv(path)


def preview(df: DataFrame, max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows with a flag that there are more; the scan stops as soon as it has enough."""
    return limit_with_flag(df, max_rows)


def preview_columnar(spark: SparkSession, path: str, fmt: str = "parquet", max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Preview of a Parquet or ORC path."""
    return preview(spark.read.format(fmt).load(path), max_rows)


def preview_delimited(spark: SparkSession, path: str, sep: str | None = None, max_rows: int = PREVIEW_ROWS) -> DataFrame:
    return preview(read_delimited(spark, path, sep), max_rows)


_TEXT = "path string, length long, text string, truncated boolean"


def _read_starts(max_bytes: int):
    """The first bytes of each file of (path, length); a character that is cut is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, where = open_store(path)
                with system.open_input_file(where) as source:
                    start = source.read_at(min(max_bytes, length), 0)
                cut = length > max_bytes
                text = codecs.getincrementaldecoder("utf-8")("replace").decode(start, final=not cut)
                columns = [pa.array([v], t) for v, t in ((path, pa.string()), (length, pa.int64()), (text, pa.string()), (cut, pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "text", "truncated"])

    return run


def preview_text(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Start of each text file in UTF-8 with its size and whether it was cut.

    No more than ``max_bytes`` of a file are read. Files whose name begins with ``_`` or
    ``.`` are left out.
    """
    files = list_tree(spark, path)
    files = files.filter(~F.substring_index("rel_path", "/", -1).rlike("^[_.]")).select(F.col("full_path").alias("path"), F.col("size").alias("length"))
    dealt = stores.dealt_by_number(files, "path", files.count(), FILES_A_TASK)
    return dealt.mapInArrow(_read_starts(max_bytes), _TEXT)


def orc_text(df: DataFrame) -> DataFrame:
    """ORC values as text where they are not numbers: ISO dates, exact decimals, binary as UTF-8."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def shown(name: str):
        c = F.col(name)
        if kinds[name] == "binary":
            return F.decode(c, "UTF-8").alias(name)
        return c.cast("string").alias(name) if kinds[name] in ("date", "decimal", "boolean") else c

    return df.select(*[shown(name) for name in df.columns])


def with_file_type(df: DataFrame, column: str = "path") -> DataFrame:
    """Tag every path of a manifest with how it is previewed."""
    c = F.col(column)
    return df.select("*", paths.extension(c).alias("extension"), paths.file_type(c).alias("file_type"))


def scan_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Relative path, full path, size and time of every file below a root that is not ignored.

    Markers and table logs (``_SUCCESS``, ``_delta_log``) are part of it: a copy without
    them is no table.  Spark's own file index would leave out every name that starts
    with ``_`` or ``.`` and hold the list on the driver.
    """
    return list_tree(spark, root)


_LISTING = "path string, is_dir boolean, length long, mtime_s long"


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            system, where = open_store(folder)
            info = system.get_file_info(where)
            single = info.type == fs.FileType.File
            listed = [info] if single else system.get_file_info(fs.FileSelector(where))
            for at in range(0, len(listed), 10_000):
                found = listed[at : at + 10_000]
                yield pd.DataFrame(
                    {
                        "path": [folder if single else child(folder, i.base_name) for i in found],
                        "is_dir": [i.type == fs.FileType.Directory for i in found],
                        "length": [int(i.size or 0) for i in found],
                        "mtime_s": [int(i.mtime.timestamp()) if i.mtime else 0 for i in found],
                    }
                )


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root (or the root itself, if it is one), level by level, with marker and table-log files.

    One Spark job per level of the tree lists all folders of that level, a given number of
    folders a task; ignored folders are not entered.  Each level is checkpointed, so
    no folder is listed twice.  Paths are URIs where the root is one.
    """
    scratch_root(spark)
    base = stores.canonical(root)
    frontier, folders = spark.createDataFrame([(base,)], "path string"), 1
    levels: list[DataFrame] = []
    while folders:
        dealt = stores.dealt_by_number(frontier, "path", folders, FOLDERS_A_TASK)
        found = dealt.mapInPandas(_list_folders, _LISTING).checkpoint()
        levels.append(found.filter(~F.col("is_dir")))
        name = F.substring_index("path", "/", -1)
        frontier = found.filter(F.col("is_dir") & ~paths.ignored_folder(name)).select("path")
        folders = frontier.count()
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    below = F.substring("path", F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    rel = F.when(F.col("path") == base, F.substring_index("path", "/", -1)).otherwise(below)
    return files.select(
        rel.alias("rel_path"), F.col("path").alias("full_path"), F.col("length").alias("size"), "mtime_s"
    ).filter(~paths.is_ignored_path(F.col("rel_path")))


_FOOTER = "path string, rows long, row_groups long, columns string, size long"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        for path in batch["path"]:
            system, where = open_store(path)
            with system.open_input_file(where) as source:
                meta = pq.ParquetFile(source).metadata
                size = source.size()
            kinds = [f"{meta.schema.column(i).path}:{meta.schema.column(i).physical_type}" for i in range(meta.num_columns)]
            yield pd.DataFrame(
                [[path, meta.num_rows, meta.num_row_groups, ",".join(kinds), size]],
                columns=["path", "rows", "row_groups", "columns", "size"],
            )


def parquet_file_stats(files: DataFrame) -> DataFrame:
    """Rows, row groups, physical column types and bytes of each Parquet file of a ``path`` list.

    Only footers are read, those of a given number of files by a task.
    """
    listed = files.select("path")
    return stores.dealt_by_number(listed, "path", listed.count(), FILES_A_TASK).mapInPandas(_footers, _FOOTER)


def parquet_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Paths of the Parquet files below a root, from the listing alone; names with ``_`` or ``.`` in front are no data."""
    name = F.substring_index("rel_path", "/", -1)
    return list_tree(spark, root).filter(name.endswith(suffix) & ~name.rlike("^[_.]")).select(F.col("full_path").alias("path"))


def check_content(content: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """SHA-256 of each content against the declared one, ignoring case; a missing one does not match."""
    hashed = content.select(key, F.sha2(F.col("content"), 256).alias("actual"))
    ok = F.coalesce(F.lower("checksum") == F.col("actual"), F.lit(False))
    return hashed.join(declared, key, "left").select(key, "actual", ok.alias("matches"))


#: Bytes of a file in memory while it is hashed.
HASH_CHUNK = 1 << 20


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file, read in pieces; null if there is no such file."""
    from pyarrow import fs

    for batch in batches:
        digests = []
        for place in batch.column(0).to_pylist():
            system, where = open_store(place)
            if system.get_file_info(where).type != fs.FileType.File:
                digests.append(None)
                continue
            digest = hashlib.sha256()
            with system.open_input_stream(where, compression=None) as source:
                while piece := source.read(HASH_CHUNK):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["place", "actual"])


def verify_checksums(spark: SparkSession, root: str, declared: DataFrame) -> DataFrame:
    """``path, actual, matches`` for the declared files (path, checksum) and all others below a root.

    Every declared row has a verdict: a file that is not there has a null digest and does not
    match. Files that the listing finds and nobody declared do not match either. Names that
    begin with ``_`` or ``.`` are checked like others; files are hashed in pieces, so
    their size does not matter, and are packed into tasks by their bytes.
    """
    asked = declared.select(F.col("path").cast("string").alias("path"), F.col("checksum").cast("string").alias("checksum"))
    asked = asked.withColumn("place", stores.canonical_path(F.col("path")))
    listed = list_tree(spark, root).select(F.col("full_path").alias("place"), "size")
    places = listed.unionByName(asked.select("place"), allowMissingColumns=True).where("place IS NOT NULL")
    places = places.groupBy("place").agg(F.max("size").alias("size"))
    dealt = stores.dealt_by_bytes(places, "place", "size").select("place")
    hashed = dealt.mapInArrow(_hash_files, "place string, actual string")
    ok = F.coalesce(F.lower("checksum") == F.col("actual"), F.lit(False))
    return asked.join(hashed, "place", "full").select(F.coalesce("path", "place").alias("path"), "actual", ok.alias("matches"))


def catalog_columns(spark: SparkSession, db: str | None = None) -> DataFrame:
    """Database, table, column and type of everything in the catalog, or in one database."""
    databases = [db] if db else [d.name for d in spark.catalog.listDatabases()]
    rows = []
    for database in databases:
        for table in spark.catalog.listTables(database):
            name = table.name if table.isTemporary else f"{database}.{table.name}"
            rows += [(database, table.name, c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "db string, table_name string, column_name string, column_type string")


def jdbc_query(spark: SparkSession, url: str, sql: str, fetchsize: int = 1000, timeout_s: int = 0, **options):
    """Reader of a remote query with fetch size and time limit."""
    reader = spark.read.format("jdbc").option("url", url).option("query", sql)
    return reader.option("fetchsize", fetchsize).option("queryTimeout", timeout_s).options(**options)


def read_jdbc_query(spark: SparkSession, url: str, sql: str, max_rows: int, **options) -> DataFrame:
    """At most ``max_rows`` rows of a remote query with a truncation flag; the limit is pushed down."""
    return limit_with_flag(jdbc_query(spark, url, sql, **options).load(), max_rows)


def read_event_log(log: DataFrame, last_id: int, batch: int = 1000) -> DataFrame:
    """The next events after a committed id, in order."""
    return log.filter(F.col("event_id") > last_id).orderBy("event_id").limit(batch)


def preview_summary(df: DataFrame, max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Rows in all, rows a preview shows, and whether it is cut; the count reads no column."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.least(total, F.lit(max_rows)).alias("returned"), (total > max_rows).alias("truncated")
    )

"""A file-system change journal turned into copies and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators.joins import manifest_diff
from strandline.operators.windows import latest_per_key
from strandline.sources.files import scan_manifest

JOURNAL_SCHEMA = "op string, path string, src string, dst string, size long, txid long"


def read_fs_journal(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Journal events as a stream of JSON files with a fixed schema."""
    return spark.readStream.schema(JOURNAL_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def journal_to_plan(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Copies and deletes of each job for each journal event.

    An event meets a job through the folders above its paths, an equi join; the
    root folder is one of them, so a job on ``/`` sees everything.  Paths are brought
    into one form and tested for staging once per event, before the join.
    """
    none = F.array().cast("array<string>")
    sides = ("path", "src", "dst")
    clean = events.select(
        "txid", "op", "size", *[F.when(F.col(c).isNotNull(), paths.path_of(F.col(c))).alias(c) for c in sides],
        *[paths.is_staged_path(F.col(c)).alias(f"{c}_staged") for c in sides],
    )
    above = F.array_distinct(
        F.concat(F.array(F.lit("/")), *[F.coalesce(paths.ancestors(F.col(c)), none) for c in sides])
    )
    roots = jobs.select(
        "job_id", "sync_deletes", "companion", "delete_table_dirs", "delete_inside_tables",
        paths.path_of(F.col("source_path")).alias("root"), paths.root_of(F.col("target_path")).alias("target_root"),
    )
    met = clean.select("*", F.explode(above).alias("root")).join(roots, "root")

    root = F.col("root")
    under = {
        c: F.col(c).isNotNull() & paths.is_below(F.col(c), root) for c in sides
    }
    staged = {c: F.col(f"{c}_staged") for c in sides}
    is_op = lambda op: F.col("op") == op
    action = lambda name, c, when: F.when(
        when, F.struct(F.lit(name).alias("action"), F.col(c).alias("file"))
    )
    arrived = is_op("RENAME") & under["dst"] & ~staged["dst"]
    left = is_op("RENAME") & under["src"] & ~staged["src"] & (~under["dst"] | ~staged["dst"])
    wanted = F.array_compact(
        F.array(
            action("COPY", "path", is_op("CLOSE") & under["path"] & ~staged["path"]),
            action("COPY", "dst", arrived),
            action("DELETE", "src", left),
            action("DELETE", "path", is_op("UNLINK") & under["path"] & ~staged["path"]),
        )
    )
    plan = met.select("*", F.explode(wanted).alias("a")).select("*", "a.action", "a.file")
    flags = [F.col(c) for c in ("sync_deletes", "companion", "delete_table_dirs", "delete_inside_tables")]
    allowed = (F.col("action") == "COPY") | paths.delete_allowed(F.col("file"), root, *flags)
    return plan.filter(allowed).select(
        "txid", "job_id", "action", "file",
        paths.moved_path(F.col("file"), root, F.col("target_root")).alias("target_file"),
        F.when(F.col("action") == "COPY", F.col("size")).alias("bytes"),
    )


def expand_dirs(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Copies with folders replaced by the unstaged files below them; files stay, vanished paths go.

    ``manifest`` has (path, size) of the files there are now.
    """
    copies = plan.filter(F.col("action") == "COPY")
    files = manifest.filter(~paths.is_staged_path(F.col("path")))
    below = files.select(
        F.col("path").alias("__file"), F.col("size").alias("__size"), F.explode(paths.ancestors(F.col("path"))).alias("file")
    )
    found = copies.join(below, "file")
    return found.select("txid", "job_id", F.col("__file").alias("file"), F.col("__size").alias("bytes"))


def last_state(plan: DataFrame) -> DataFrame:
    """Last planned action of every file of a job in a batch."""
    return latest_per_key(plan, ["job_id", "file"], ["txid"])


def batch_progress(plan: DataFrame, failed_jobs: DataFrame | None = None) -> DataFrame:
    """Greatest transaction of every job in a batch; a job with a failed part does not move."""
    moved = plan.groupBy("job_id").agg(F.max("txid").alias("txid"))
    return moved if failed_jobs is None else moved.join(failed_jobs, "job_id", "left_anti")


def advance(positions: DataFrame, batch: DataFrame) -> DataFrame:
    """Positions after a batch; they never go back."""
    both = positions.unionByName(batch.select(*positions.columns))
    return both.groupBy("job_id").agg(F.max("txid").alias("txid"))


def recover_gap(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full comparison after lost journal events: what to copy, and what to delete on the target."""
    copies = manifest_diff(source, target).filter(F.col("action") == "QUEUED")
    extra = target.select("rel_path", "size").join(source.select("rel_path"), "rel_path", "left_anti")
    return copies.select("rel_path", F.lit("COPY").alias("action")).unionByName(
        extra.select("rel_path", F.lit("DELETE").alias("action"))
    )


def recover_job(spark: SparkSession, source_root: str, target_root: str) -> DataFrame:
    """``recover_gap`` of one job's folders, listed anew."""
    return recover_gap(scan_manifest(spark, source_root), scan_manifest(spark, target_root))



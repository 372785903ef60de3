"""Session defaults, block width and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows of one ordered block (see ``operators.ordered``) when the order column is
#: a unique integer; overridden with the session setting of the same name.
BLOCK_ROWS_SETTING = "strandline.block.rows"
BLOCK_ROWS_DEFAULT = 65_536


def get_session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; every value can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_SETTING, str(BLOCK_ROWS_DEFAULT)))


def block_of(col: Column, width: int | None = None) -> Column:
    """Order-preserving block number of an integer column.

    A block of a *unique* integer holds at most ``width`` rows of one key, so a
    window over (key, block) has a proven size bound even for a hot key.
    """
    if width is None:
        active = SparkSession.getActiveSession()
        width = block_rows(active) if active else BLOCK_ROWS_DEFAULT
    return F.floor(col / F.lit(width)).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a temporary folder is made
    and set as the checkpoint folder on one machine; on a cluster, whose executors
    could not see it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables written between two jobs."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")

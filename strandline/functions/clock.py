"""Epoch seconds and microseconds of time columns, whatever the session zone is."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, without a zone shift."""
    start = F.lit(datetime.date(1970, 1, 1)).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts)


def epoch_s(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / 1_000_000).cast("long")

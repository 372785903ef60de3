"""Spark jobs for the data work around a data lake.

Manifest and schema comparison, change-log application, record filtering and
re-encoding, offset translation, and the progress, histogram, ranking and alert
queries that run over them.  Every operator takes DataFrames and gives a
DataFrame; only bounded summaries reach the driver.
"""

import sys

from pyspark import cloudpickle

from strandline.session import get_session, scratch_path

# The few functions that run in Python workers travel with the job, so the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "scratch_path"]

"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this folder imports it; ``corpus_pipeline.py`` at the repository
top and ``__spark_entry__.py`` are the only users.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

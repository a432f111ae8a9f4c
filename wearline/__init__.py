"""Predictive-maintenance analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Tidemark: point-in-time analytics and data preparation on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with their code, so that workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Massif: a PySpark-native engine for hierarchical spatial data and training corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native register extraction, validation and corpus preparation.

The package is pickled by value, so that executors need no copy of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Typed record search and data preparation on Spark.

The package is shipped to Python workers by value, so a cluster needs no copy of
it on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

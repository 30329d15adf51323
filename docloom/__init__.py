"""Document analytics and retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

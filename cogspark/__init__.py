"""Analytics for learning data on Spark: functions from DataFrames to DataFrames.

The package's Python helpers are pickled by value, so that executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

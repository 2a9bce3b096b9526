"""Spark-native analytics for market-integrity data.

Everything is a function from DataFrames to a DataFrame (or a Column builder);
no object holds data and nothing is collected unless its size has a bound that
is stated where it happens.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value: it needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Event-timeline features and experiment-result analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no install of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

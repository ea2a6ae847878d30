"""Scholion: relational analytics over scholarly metadata, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry the package's code, which needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

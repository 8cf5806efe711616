"""Spark-native analytics for reasoning-budget experiments."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for large training-data pipelines.

Nothing outside this folder imports it, so it can be removed as a whole.
Functions shipped to executors are pickled by value: workers need numpy, pyarrow and the
libraries an operator names, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

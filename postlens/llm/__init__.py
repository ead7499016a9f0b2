"""Operators for preparing training data: ten operators, one module each.

Nothing else in the library imports this package.  Functions that run inside Python
workers are shipped by value, so executors need numpy and pyarrow but not this code.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

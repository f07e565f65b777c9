"""Operators for preparing training data: deduplication, filtering, tokenising and packing.

Nothing outside this package imports it. Its Python functions travel to the executors by value,
so that an executor needs the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data preparation; nothing else in the library imports this package.

Python functions of this package are sent to the executors by value, so they need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline. Nothing outside this package imports it.

Functions of this package travel to the executors by value, so that a cluster
needs nothing but the driver's copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

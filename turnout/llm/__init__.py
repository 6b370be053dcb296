"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get the operators' code with their functions, so workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

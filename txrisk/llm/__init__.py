"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions run on executors that need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

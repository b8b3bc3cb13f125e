"""A PySpark library for molecule- and cell-level spatial data: every operator is a function from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their own code: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

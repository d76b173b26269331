"""tokenpress: condensing, ranking and routing text for language models, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to its Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

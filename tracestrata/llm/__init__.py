"""Operators for large training-data pipelines, each built by a method of its own.

Every operator takes a DataFrame, uses only the columns it names (further
columns, whatever their names, are ignored) and returns a DataFrame. Nothing
else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

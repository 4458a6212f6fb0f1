"""Operators for training-data pipelines over a table of documents.

Functions that run on executors travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

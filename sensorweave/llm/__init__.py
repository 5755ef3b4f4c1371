"""Operators for training-data pipelines over documents, pages and their labels.

Functions of this subpackage travel to executors by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

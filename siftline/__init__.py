"""Siftline: a Spark-native engine for curating text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their modules, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

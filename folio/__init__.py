"""Paged documents, their chapter trees, versions and citations as Spark jobs."""

import sys

from pyspark import cloudpickle

# tasks carry this library's functions by value: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

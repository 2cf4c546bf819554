"""Spark jobs for change histories of entity documents, and for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no
# installed copy of it and the workers' import path does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

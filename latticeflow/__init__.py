"""Volumetric array and spatial graph analytics as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with each job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

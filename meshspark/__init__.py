"""Geometry analytics on Spark: meshes, point clouds, volumes and streaming meshes as DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel with the plan: executors need numpy and pandas, but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""lumenframe: tables of 2D/3D image volumes, and seeded plans of array operators over them, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their source, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

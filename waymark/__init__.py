"""waymark: address search and geocoding analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so the workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

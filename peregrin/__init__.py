"""peregrin: a Spark-first engine for travel analytics.

Python workers receive the library's functions by value, so that a cluster's
executors need no copy of the package beside the usual third-party wheels.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

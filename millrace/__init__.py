"""Real-time retail analytics written as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Processors and Pandas functions travel to the executors as code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

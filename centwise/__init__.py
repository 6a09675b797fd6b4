"""centwise: personal-finance analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on Python workers travel by value, so a worker
# needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A PySpark-native engine for code-inventory, diff, evidence and corpus queries."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors whole, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

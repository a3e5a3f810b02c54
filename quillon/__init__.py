"""Document analytics on Spark: JSON documents as canonical, shreddable column values."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

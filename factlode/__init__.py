"""Code and document intelligence as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so it needn't be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""gridspark: gridded space-time analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so these need not find the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

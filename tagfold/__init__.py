"""tagfold: barcode/UMI read de-duplication on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "0.2.0"

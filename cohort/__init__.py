"""cohort: keep labelled data sets honest, from raw files to published scores, on Spark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need no copy of this package, and the
# driver may be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

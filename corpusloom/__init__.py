"""Document-corpus analytics as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that executors do not need this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

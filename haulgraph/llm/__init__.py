"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

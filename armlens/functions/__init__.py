"""Column helpers, distribution functions and small solves."""

import sys

from pyspark import cloudpickle

# UDFs carry their helpers with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Windowed and grouped quantile analytics for Spark tables and streams."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the code they use along, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

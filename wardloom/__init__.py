"""wardloom: ward-process analytics and event-data preparation on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel whole, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

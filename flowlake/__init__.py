"""flowlake: network-telemetry analytics as PySpark DataFrame and streaming operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the task, so executors do not
# need the package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

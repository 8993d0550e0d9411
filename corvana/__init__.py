"""corvana: corpus retrieval and learning analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

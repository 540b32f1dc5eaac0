"""wordloom: text-corpus analytics as DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

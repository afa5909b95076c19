"""tarnstone: a Spark-native retrieval and analytics engine over a knowledge base."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the Python workers with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

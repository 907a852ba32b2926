"""Lodestone: retrieval and corpus analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

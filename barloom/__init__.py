"""Causal market-bar features and forecast evaluation as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code with them, so workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

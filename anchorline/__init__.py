"""Grounded entity-disambiguation analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# functions that go to workers take what they need along, so that executors needn't have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

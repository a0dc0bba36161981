"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job: the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

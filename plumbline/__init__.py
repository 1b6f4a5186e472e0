"""plumbline: tabular regression experiments expressed as Spark DataFrame work."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

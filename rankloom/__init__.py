"""Rankloom: text-retrieval experiments as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need
# neither this package installed nor a copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

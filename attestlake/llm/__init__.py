"""Operators for preparing training data; `queries` registers one query for each of them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need not have this
# package installed and jobs can be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

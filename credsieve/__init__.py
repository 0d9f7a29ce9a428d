"""Credential-exposure analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the task, so executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for building training corpora: one module each, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the job, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

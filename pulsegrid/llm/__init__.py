"""Operators that prepare text corpora for training.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Python workers get these modules' functions by value: a cluster's executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

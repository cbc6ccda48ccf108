"""Operators for training corpora: cleaning, deduplication, scoring, formatting and packing."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# the kernels travel with their tasks, so executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])

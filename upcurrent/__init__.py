"""Dependency-update analytics and corpus preparation on Spark.

Worker functions are pickled by value, so executors need Spark's Python environment only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Document-corpus analytics on Spark: every operator is a DataFrame or Column function."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# functions that run in Python workers travel with their task: executors need no installed copy
register_pickle_by_value(sys.modules[__name__])

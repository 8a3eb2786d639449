"""Open-set vector classification and event analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with the job, so executors need
# Spark's own Python dependencies but not this package.
register_pickle_by_value(sys.modules[__name__])

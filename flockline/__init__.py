"""flockline: clustering, tracking and alerting over short posts, on Spark.

Every operator is a function from DataFrames to a DataFrame, so the same code
runs in batch jobs and inside ``foreachBatch``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

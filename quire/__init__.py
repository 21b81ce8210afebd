"""Quire: set-at-a-time analytics over document libraries, written for Spark.

Every operator takes and returns DataFrames.  Single-item calls are the same plan
run on a one-row driving table.
"""

import sys

from pyspark import cloudpickle

# UDF helpers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

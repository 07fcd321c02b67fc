"""tablescope: exploratory analytics over Spark DataFrames of any size.

Every operator takes a DataFrame and returns a DataFrame.  Values that must be
known before a plan can be written (category lists, scaler moments, k-means
centres) are read by one small, size-bounded job; everything else stays lazy.
"""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers inside the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

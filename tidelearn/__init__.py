"""Online learning on tables and streams, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Small helpers used inside Arrow tasks travel with the task, so executors do
# not need this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

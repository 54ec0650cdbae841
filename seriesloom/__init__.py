"""Forecasting and validation of sensor time series as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few small Python functions that run in tasks travel with the job, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""fleetgauge: metrics, alerts and logs analytics for server fleets on Spark."""

import sys

from pyspark import cloudpickle

# The few Python task functions travel with their job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

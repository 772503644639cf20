"""Public-transport telemetry on Spark."""

import sys

from pyspark import cloudpickle

# functions and state processors travel to executors with the job, so that a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""pulsewide: satisfaction-driver analytics as Spark jobs over attribute-value data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with the job, so the
# package needs to be installed only where the application starts.
register_pickle_by_value(sys.modules[__name__])

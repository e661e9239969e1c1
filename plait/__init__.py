"""plait: Spark-native analytics for near-identical repeat copies in noisy sequence data."""

import sys

from pyspark import cloudpickle

# Python workers may not have this package on their path, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

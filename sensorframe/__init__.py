"""Spark-native analytics for large collections of sensor series and spectra."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

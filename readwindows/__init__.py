"""Read-window analytics on Spark: labelled training tables from aligned DNA reads."""

import sys

from pyspark import cloudpickle

from readwindows.params import Params

# Functions that run in tasks travel with them; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]

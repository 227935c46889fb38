"""Next-token predictability catalogues for large text corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from foretoken.settings import Settings

# Functions sent to executors travel whole, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]

"""wavemill: waveform analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so that executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

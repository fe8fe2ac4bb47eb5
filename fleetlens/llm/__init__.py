"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions that run in tasks are shipped by value, so executors need only the third-party
libraries (numpy, pandas, pyarrow, regex, xxhash), not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

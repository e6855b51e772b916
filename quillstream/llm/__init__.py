"""Operators for preparing training data. Nothing outside this subpackage imports it.

Functions that run on executors are sent by value, so executors need only the libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

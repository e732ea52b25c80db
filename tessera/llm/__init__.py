"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing else in the library imports this subpackage. Its functions are pickled by value, so
executors need the third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a large-scale training-data pipeline over documents, pages and
embeddings. Nothing else in the library imports this subpackage.

The functions that run inside tasks are sent to the executors by value, so a
cluster needs the third-party libraries but no installed copy of this code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

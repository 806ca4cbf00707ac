"""Operators on training text: de-duplication, cleaning, classification, packing, sharding, archives.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage that run in Python workers travel by value, so that
# workers need not have the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for large text corpora: mixing, de-duplication, sharding, cleaning, archives.

Functions of this package that run in tasks are sent by value, because executors need not have the
package installed, and their working folder need not be the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: extraction, filtering, deduplication, tokens, packing.

The task functions of this package are sent to the executors by value, so a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

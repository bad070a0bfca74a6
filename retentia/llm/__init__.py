"""Training-data operators: scoring, deduplication, decontamination, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` registers one thin query per operator.
"""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

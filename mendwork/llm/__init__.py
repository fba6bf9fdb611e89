"""Operators for large training corpora.

Each module holds one operator with a general interface; ``queries`` applies
them to the driver tables and derives the contract columns from their output.
Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators over pages, records, runs and candidates."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

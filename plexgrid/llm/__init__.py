"""Operators for preparing text corpora: ten operators, their queries and SQL.

Nothing else in the library imports this subpackage. Its functions are sent to
the executors by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

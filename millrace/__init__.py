"""millrace: a Spark-native engine for curating training data.

Everything is declared on DataFrames; Python runs only in Arrow batches where
no built-in expression has the meaning that is asked for.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions shipped to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

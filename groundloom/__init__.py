"""groundloom: grounded retrieval and conversation-intake analytics as Spark DataFrame transforms.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing here triggers
an action except the explicitly documented size checks and the sinks.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

# Functions that run in Python workers travel with the task, so executors need no copy of this package.
_by_value(_sys.modules[__name__])

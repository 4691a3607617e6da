"""pledgelens: page, text and outcome analytics as PySpark DataFrame operators.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns, so they chain with ``DataFrame.transform`` and stay lazy.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helper functions travel inside the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

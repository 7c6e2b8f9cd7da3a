"""larkspan: a PySpark-native analytics library.

Python functions of this package are pickled by value, so executors need
Spark, pyarrow and numpy but no copy of the package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

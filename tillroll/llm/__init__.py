"""Training-data operators on Spark DataFrames. Nothing outside imports this.

Functions that run inside tasks are pickled by value, so executors need only
PySpark, pyarrow and numpy (and the hash or tokenizer library an operator
names), not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: each module holds one operator and its registered query.

Functions of this subpackage that run inside tasks are pickled by value, so the
executors need numpy, pyarrow and the named libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

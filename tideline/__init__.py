"""Daily-bar momentum research on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver unless its size is bounded by the caller's own options.
"""

import sys

from pyspark import cloudpickle

# grouped-map helpers travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

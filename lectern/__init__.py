"""Document-retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the functions used inside tasks with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Evidence retrieval and knowledge-graph analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with their code, so executors need
# nothing installed and the working directory does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

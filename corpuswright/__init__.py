"""corpuswright: build, search and evaluate question-answering corpora on Spark.

Every operator is a function from DataFrame to DataFrame (or Column to Column),
so Catalyst sees one declarative plan per job.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

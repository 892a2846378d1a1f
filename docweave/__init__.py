"""docweave: a PySpark engine for building and querying a corpus of web documents."""

import sys

from pyspark import cloudpickle

from docweave.config import Settings
from docweave.plans.engine import DocumentEngine

# The few functions that run in Python workers travel with the job: executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DocumentEngine", "Settings"]

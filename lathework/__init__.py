"""Evidence, registry and document-integrity analytics on Spark DataFrames."""

import sys

try:  # functions shipped to executors travel by value, so workers need not have this package installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError):  # pragma: no cover
    pass

__version__ = "0.1.0"

"""flipside: counterfactual text augmentation as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python UDFs of this package are shipped by value, so executors need no
# installed copy of the package (works the same on a cluster and locally).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

"""seqlab: ordered event logs to sessions, features, labels, models and rules on Spark."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (Arrow batch
# operators, streaming state functions) are shipped by value, so executors
# need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler without the hook
    pass

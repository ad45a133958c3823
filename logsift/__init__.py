"""Security-log analytics on Spark: parse, normalise, score, hash, detect and search."""

import sys

from pyspark import cloudpickle

from logsift.session import configure, local_session

# Functions run on executors travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "local_session"]

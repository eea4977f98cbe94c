"""Spark-first analytics over append-only ledgers, their transactions and their events.

Python functions that run on executors travel by value with the job, so a cluster needs
no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

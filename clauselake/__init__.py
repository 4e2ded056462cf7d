"""clauselake: terms, page-risk and result-store analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

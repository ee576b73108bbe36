"""graphrecon: rebuild and judge networks from scored pairs, as Spark jobs.

Functions that run inside tasks travel with their code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""quern: interaction analytics, similarity and recommendation as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

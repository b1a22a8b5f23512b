"""semspark: analytics for high-order element data as DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

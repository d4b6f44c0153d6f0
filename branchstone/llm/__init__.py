"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# executors need not have the package installed: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])



import sys

from pyspark import cloudpickle

# functions that run on executors are pickled by value, so that a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

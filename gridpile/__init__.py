"""Pairwise-window aggregation of sparse interaction matrices, and corpus preparation, as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions that Spark sends to its Python workers carry their code, wherever this package lies on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

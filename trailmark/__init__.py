"""Trailmark: Spark-native analytics for trajectories, sensor grids and descriptors.

Every public operator takes DataFrames and returns a lazy DataFrame; Catalyst
picks the physical plan.  See README.md for the map of the package.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that executors need
# PySpark and NumPy but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

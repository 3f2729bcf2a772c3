"""Raster and volume analytics expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: task helpers travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

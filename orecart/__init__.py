"""Orecart: a Spark-native engine for chunking, searching and mapping text collections."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: what runs on them travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""fieldloom: field mapping, lineage, retrieval, graphs and training-data preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the workers with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

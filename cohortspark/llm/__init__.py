"""Operators of a training-data pipeline: near duplicates, filters, records, packing."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

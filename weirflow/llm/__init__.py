"""Operators for building training data: filtering, deduplication, tokenizing, mixing and scoring of texts."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Feature tables over hierarchical relational data, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from hierfeat.session import build_session
from hierfeat.spec import BuildConfig, HierarchySpec, TableSpec

# Functions of this package travel inside the jobs that use them, so executors need no
# copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BuildConfig", "HierarchySpec", "TableSpec", "build_session"]

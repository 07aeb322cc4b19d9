"""catalogmap: turn a catalog and its reviews into a semantic map with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from catalogmap.session import build_session, cut, scratch_dir

# Tasks carry the package's own functions, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut", "scratch_dir"]
__version__ = "0.1.0"

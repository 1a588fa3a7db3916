"""newsframe: news-article analytics on Spark DataFrames.

Column functions live in ``newsframe.functions`` (pure projections, usable on
batch and streaming frames), DataFrame -> DataFrame operators in
``newsframe.operators``, readers in ``newsframe.sources``, writers in
``newsframe.sinks``, composed jobs in ``newsframe.plans`` and Structured
Streaming jobs in ``newsframe.streaming``.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python workers travel by value, so executors need no
# copy of this package on their path (it may exist on the driver only).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

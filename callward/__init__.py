"""Conversation-risk analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the workers inside the job, so no
# files need to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

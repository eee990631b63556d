"""scholium: a Spark-native engine for document-centric learning data."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions and classes inside the task (broadcast
# objects: scholium.llm.common.Shared), so a job needs no installed copy of the
# package on the workers. Third-party packages must be there: see pyproject.toml.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

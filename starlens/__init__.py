"""starlens: star-schema retail analytics as plain DataFrame-in, DataFrame-out functions.

Sub-packages
    sources    tables, files, generated data, saved graphs, the canonical sales projection
    functions  column expressions (dates, text, vectors, question intent, answer lines)
    operators  DataFrame operators built from them
    plans      named queries over the shipped tables, each beside its SQL twin
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for building training corpora; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import counterlens.llm as _package

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(_package)

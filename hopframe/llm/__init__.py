"""Operators of a training-data pipeline; nothing outside this package imports it."""

from pyspark import cloudpickle as _cloudpickle

# Tasks receive the helpers of this package with their functions and need no copy of it on their path.
_cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["llm"]))

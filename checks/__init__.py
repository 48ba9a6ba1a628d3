"""Registered queries, each next to the SQL that has to give the same rows."""

import sys

from pyspark import cloudpickle

# Workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from checks import examples, scores, sources, tables, texts  # noqa: E402, F401
from checks.registry import QUERIES, SQL  # noqa: E402

__all__ = ["QUERIES", "SQL"]

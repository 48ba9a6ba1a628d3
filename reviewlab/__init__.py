"""Review/reply text analytics as Spark jobs.

``functions``  Column -> Column expressions
``operators``  DataFrame -> DataFrame steps
``sources``    scans and sinks
``streaming``  the two incremental jobs
``plans``      end-to-end jobs composed from the above
``scale``      shared patterns for hot keys, global order and lookup joins
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers as they are, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""marquee: catalogue, interaction and recommendation analytics as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function.  The modules are
grouped as ``sources`` (tables and files in and out), ``functions`` (column
expressions), ``operators`` (one data-processing step each), ``plans``
(compositions and the registered query list) and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

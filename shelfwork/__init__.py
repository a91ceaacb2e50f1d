"""shelfwork: preparing, classifying and auditing product catalogues on Spark.

Every public function takes and returns a ``DataFrame`` (or a ``Column``), so
Catalyst sees one declarative plan from scan to sink.
"""

import sys

from pyspark import cloudpickle

# Python workers receive our small task functions by value, so a cluster needs
# no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

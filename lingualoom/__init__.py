"""Translation-corpus analytics as Spark jobs.

Tables of documents become tables of segments, units, translations, scores and reports.  Every
operator is a plain ``DataFrame -> DataFrame`` function; nothing here keeps session state.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Arrow functions travel with the job by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

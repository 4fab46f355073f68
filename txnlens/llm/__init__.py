"""Operators for training corpora: counting, mixing, joining, filtering and deduplicating documents.

Their column functions run in tasks on machines that need not have this package installed, so the
package is shipped with them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators that prepare text, vectors and dialogues for training language models.

Nothing else in the library imports this subpackage. Functions that run in Python workers travel by
value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators that prepare training text: filters, near duplicates, mixing, tokens.

Nothing else in the package imports this one. Functions that run inside tasks are sent by value,
so executors need no installed copy of this package, but numpy, pandas, pyarrow, xxhash, regex and
tokenizers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

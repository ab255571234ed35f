"""Operators for preparing language-model training data.

Nothing outside this package imports it. Kernels that run inside tasks
travel by value with the task closures, so executors need only the public
libraries (numpy, pyarrow, tokenizers, regex), not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

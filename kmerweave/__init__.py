"""Biological-sequence analytics as PySpark DataFrame jobs.

Sequences, words (k-mers), exact-match seeds, similar segments, overlap bands
and alignments are all DataFrames; every operator takes DataFrames and returns
a DataFrame, so one job serves every pair of sequences at once. Most are lazy;
those that cut lineage run jobs when they are called.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value. What they refer to may
# not, so the package has to be on the workers' path as well (``--py-files``).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from kmerweave.functions.alphabet import Alphabet, DNA, DNA_LOWER  # noqa: E402
from kmerweave.session import build_session  # noqa: E402

__all__ = ["Alphabet", "DNA", "DNA_LOWER", "build_session"]

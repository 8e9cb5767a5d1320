"""Operators of a training-data pipeline: packing, archives, personal data, duplicates, tokens, quality, shards.

Functions that run in Python workers are sent by value, so the workers need not have this package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

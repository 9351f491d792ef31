"""Distance between doubles, for reports about rows that already differ."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _ranks(values: pd.Series) -> np.ndarray:
    """Doubles as integers in the same order, neighbours one apart."""
    bits = values.to_numpy(dtype="float64").view("int64")
    return np.where(bits >= 0, bits, np.iinfo("int64").min - bits)


def ulp_distance(left: Column, right: Column, cap: int = 1000) -> Column:
    """Representable doubles between two values, at most ``cap``."""

    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = _ranks(a), _ranks(b)
        # The difference of two 64-bit integers needs the unsigned range.
        gap = np.maximum(x, y).view("uint64") - np.minimum(x, y).view("uint64")
        return pd.Series(np.minimum(gap, np.uint64(cap)).astype("int64"))

    return F.pandas_udf(distance, "bigint")(left, right)

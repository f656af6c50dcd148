"""Random columns. With a seed, a row's value depends on the seed and on its place in its partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def uniform(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number from ``low`` up to but not including ``high``."""
    return low + F.rand(seed) * (high - low)


def gaussian(seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return mean + F.randn(seed) * deviation


def toss(seed: int, p: float = 0.5) -> Column:
    """True with probability ``p``."""
    return F.rand(seed) < p


def whole(seed: int) -> Column:
    """Any long."""
    return F.xxhash64(F.rand(seed), F.lit(seed))


def pick(seed: int, values: list) -> Column:
    """One of the values."""
    return F.get(F.array(*map(F.lit, values)), F.floor(F.rand(seed) * len(values)).cast("int"))


def gamma(key: Column, shape: float, scale: float = 1.0) -> Column:
    """A gamma variate that depends on ``key``, a long, alone."""

    @pandas_udf(T.DoubleType())
    def draw(k: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(v) & (2**64 - 1)).gamma(shape, scale) for v in k])

    return draw(key)

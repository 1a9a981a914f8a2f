"""The standard normal law for small result tables."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(z: Column) -> Column:
    """Normal distribution function; Spark has no error function of its own."""

    @F.pandas_udf("double")
    def cdf(values: pd.Series) -> pd.Series:
        return values.map(NormalDist().cdf, na_action="ignore")

    return cdf(z)


def norm_quantile(p: float) -> float:
    """Inverse normal law of a parameter, infinite at the ends."""
    if p <= 0.0:
        return float("-inf")
    if p >= 1.0:
        return float("inf")
    return NormalDist().inv_cdf(p)

"""Split-conformal widening of forecast bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.functions.exprs import rate
from causalbars.plans.quantiles import exact_quantiles


def nonconformity(target: str) -> Column:
    """How far the target lies outside the band; negative inside."""
    y = F.col(target)
    return F.greatest(F.col("p10") - y, y - F.col("p90"))


def calibration_level(n: Column, alpha: float) -> Column:
    return F.least(F.ceil((1.0 - alpha) * (n + 1)) / n, F.lit(1.0))


class ConformalBand:
    """Widens [p10, p90] so that it covers ``1 - alpha`` of new targets."""

    def __init__(self, alpha: float = 0.10, keys: Sequence[str] = ()):
        if not 0.0 < alpha < 1.0:
            raise ValueError("alpha must be in (0, 1)")
        self.alpha, self.keys = alpha, list(keys)
        self.fitted: DataFrame | None = None

    def fit(self, calibration: DataFrame, target: str) -> DataFrame:
        """(keys, n, q_hat): the calibrated widening, never negative.

        The level depends on the sample size and is part of the same lazy plan.
        """
        scored = calibration.withColumn("_score", nonconformity(target))
        level = calibration_level(F.col("n"), self.alpha)
        q = exact_quantiles(scored, self.keys, "_score", {"q_hat": level})
        self.fitted = q.withColumn("q_hat", F.greatest("q_hat", F.lit(0.0)))
        return self.fitted

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``p10_adj``, ``p90_adj`` and ``band_width``."""
        if self.fitted is None:
            raise RuntimeError("fit() comes first")
        if self.keys:
            df = df.join(self.fitted.select(*self.keys, F.col("q_hat").alias("_q")), self.keys, "left")
        else:
            df = df.withColumn("_q", self.fitted.select("q_hat").scalar())
        return (
            df.withColumn("p10_adj", F.col("p10") - F.col("_q"))
            .withColumn("p90_adj", F.col("p90") + F.col("_q"))
            .withColumn("band_width", F.col("p90_adj") - F.col("p10_adj"))
            .drop("_q")
        )

    def fit_transform(self, calibration: DataFrame, target: str, test: DataFrame) -> DataFrame:
        self.fit(calibration, target)
        return self.transform(test)


def coverage(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of targets inside the raw and inside the widened band."""
    y = F.col(target)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate((y >= F.col("p10")) & (y <= F.col("p90"))).alias("raw_coverage"),
        rate((y >= F.col("p10_adj")) & (y <= F.col("p90_adj"))).alias("adj_coverage"),
    )

"""Execution-aware position sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_signals(signals: DataFrame, features: DataFrame) -> DataFrame:
    """Close, ADV and realised volatility at each signal's (ticker, t0)."""
    columns = ["close", "adv", "realized_vol"]
    at = features.select("ticker", F.col("timestamp").alias("t0"), *columns)
    return signals.drop(*columns).join(at, ["ticker", "t0"], "left")


@dataclass(frozen=True)
class PositionSizer:
    """Sizes grow with confidence and shrink with cost, impact and illiquidity.

    ``cost_twice`` keeps the compatible rule that a signal must beat its base cost
    twice; switch it off to charge it once.
    """

    max_position_frac: float = 0.05
    min_confidence: float = 0.1
    cost_bps: float = 5.0
    spread_bps: float = 3.0
    impact_coeff: float = 0.1
    max_adv_frac: float = 0.01
    widest_band: float = 10.0
    cost_twice: bool = True

    def compute_sizes(self, signals: DataFrame, portfolio_value: float = 1_000_000.0) -> DataFrame:
        """Confidence, costs, limits, final size and direction; a pure projection."""
        have = set(signals.columns)
        band = F.greatest(F.col("band_width"), F.lit(0.0))
        adv_dollars = F.col("adv") * F.col("close") if "close" in have else F.col("adv")
        vol = F.col("realized_vol") if "realized_vol" in have else F.lit(0.01)
        act = F.col("meta_decision") if "meta_decision" in have else F.lit(1)
        base_cost = self.spread_bps / 10_000.0 + self.cost_bps / 10_000.0

        df = signals.withColumns(
            {
                "confidence": 1.0 / (1.0 + band),
                "total_cost_est": F.lit(base_cost),
                "net_expected_ret": F.abs("p50") - base_cost,
                "adv_size_limit": adv_dollars * self.max_adv_frac / portfolio_value,
            }
        ).withColumn("raw_size_frac", F.col("confidence") * self.max_position_frac)
        limit = F.col("adv_size_limit")
        share_of_adv = F.col("raw_size_frac") / F.when(limit.isNotNull(), F.greatest(limit, F.lit(1e-8)))
        df = df.withColumn(
            "impact_cost_est",
            self.impact_coeff
            * vol
            * F.sqrt(F.when(share_of_adv.isNotNull(), F.greatest(share_of_adv, F.lit(0.0)))),
        )
        hurdle = F.col("impact_cost_est") + (base_cost if self.cost_twice else 0.0)
        skip = (
            (act == 0)
            | (F.col("confidence") < self.min_confidence)
            | F.coalesce(F.col("net_expected_ret") < hurdle, F.lit(False))
            | (band > self.widest_band)
        )
        # least() skips a missing limit, which then does not bind
        capped = F.least(F.col("raw_size_frac"), limit)
        return df.withColumn("final_size_frac", F.when(F.coalesce(skip, F.lit(False)), 0.0).otherwise(capped)).withColumns(
            {
                "direction": F.signum("p50").cast("int"),
                "final_size_dollars": F.col("final_size_frac") * portfolio_value,
            }
        )


def sizing_summary(sized: DataFrame) -> DataFrame:
    acted = F.col("final_size_frac") > 0
    n = F.count(F.lit(1))
    return sized.agg(
        n.alias("total_signals"),
        F.count_if(acted).alias("acted"),
        F.count_if(F.col("final_size_frac") == 0).alias("skipped"),
        (F.count_if(acted) / F.greatest(n, F.lit(1))).alias("act_rate"),
        F.coalesce(F.avg(F.when(acted, F.col("final_size_frac"))), F.lit(0.0)).alias("mean_size_frac"),
        F.avg("confidence").alias("mean_confidence"),
    )

"""Overfitting-aware evaluation of strategies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from causalbars.functions.exprs import rate
from causalbars.functions.normal import norm_cdf, norm_quantile
from causalbars.operators.backtest import STRATEGY, YEAR
from causalbars.plans.series import numbered
from causalbars.plans.staging import stage

# Euler-Mascheroni constant, significance level, candidate multipliers.
EULER = 0.5772156649
SIGNIFICANT = 0.95
MULTIPLIERS = (0.6, 0.8, 1.0, 1.2, 1.4)


def sharpe_moments(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Count, mean, deviation, skewness and excess kurtosis of the finite returns.

    A strategy without any finite return stays, with a count of 0 and null moments.
    """
    value = F.col(ret)
    r = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return returns.groupBy(STRATEGY).agg(
        F.count(r).alias("n_obs"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.skewness(r).alias("skewness"),
        F.kurtosis(r).alias("excess_kurtosis"),
    )


def deflated_sharpe(
    returns: DataFrame,
    n_trials: int,
    benchmark: float = 0.0,
    periods: int = YEAR,
    variance_form: str = "compat",
    ret: str = "ret",
) -> DataFrame:
    """Sharpe ratio, its probability and the ratio deflated for ``n_trials`` attempts.

    ``variance_form``: ``compat`` puts (excess + 1) / 4 into the variance of the ratio,
    ``published`` (excess + 2) / 4.  Fewer than 10 returns, or constant ones, give the
    neutral row.
    """
    if variance_form not in ("compat", "published"):
        raise ValueError("variance_form must be 'compat' or 'published'")
    trials = max(n_trials, 1)
    ceiling = (1.0 - EULER) * norm_quantile(1.0 - 1.0 / trials) + EULER * norm_quantile(
        1.0 - 1.0 / (trials * math.e)
    )
    shift = 1.0 if variance_form == "compat" else 2.0
    year = math.sqrt(periods)
    usable = (F.col("n_obs") >= 10) & (F.col("std") >= 1e-12)
    sr = F.when(usable, F.col("mean") / F.col("std"))
    variance = (
        1.0 - F.col("skewness") * F.col("_sr") + (F.col("excess_kurtosis") + shift) * F.col("_sr") ** 2 / 4.0
    ) / F.when(usable, F.col("n_obs") - 1)
    df = (
        sharpe_moments(returns, ret)
        .withColumn("_sr", sr)
        .withColumn("_sd", F.when(usable, F.greatest(F.sqrt(variance), F.lit(1e-10))))
        .withColumn("_psr", norm_cdf((F.col("_sr") - benchmark) / F.col("_sd")))
        .withColumn("_e_max", F.lit(ceiling) * F.col("_sd") + benchmark)
    )
    if math.isinf(ceiling):
        dsr = F.lit(1.0 if ceiling < 0 else 0.0)
    else:
        dsr = norm_cdf((F.col("_sr") - F.col("_e_max")) / F.col("_sd"))
    flat = F.when(F.col("n_obs") < 10, 0.0).otherwise(0.5)
    return df.withColumn("_dsr", dsr).select(
        STRATEGY,
        "n_obs",
        F.coalesce(F.col("_sr") * year, F.lit(0.0)).alias("sr"),
        F.coalesce("_sr", F.lit(0.0)).alias("sr_per_period"),
        F.when(usable, F.col("_psr")).otherwise(flat).alias("psr"),
        F.when(usable, F.col("_dsr")).otherwise(0.0).alias("dsr"),
        F.when(usable, F.col("_e_max") * year).alias("e_max_sr"),
        F.when(usable, F.col("skewness")).alias("skewness"),
        F.when(usable, F.col("excess_kurtosis")).alias("excess_kurtosis"),
        F.lit(n_trials).alias("n_trials"),
        (usable & (F.col("_dsr") > SIGNIFICANT)).alias("is_significant"),
    )


_TILE = 256  # strategies in a tile
_CELLS = 1 << 20  # numbers of all strategies that one task holds for its splits


def overfitting_probability(
    returns: DataFrame, n_subsets: int = 4, periods: int = YEAR, t: str = "t", ret: str = "ret"
) -> DataFrame:
    """Probability that the best strategy in sample falls below the median out of sample.

    Returns are cut into ``n_subsets`` equal blocks of time.  All a Sharpe ratio needs
    from a block is its count, mean and variance, so the data is aggregated once into
    (strategy, block) statistics.  What the two halves of every split hold is then a matrix product, (splits x blocks) times
    (blocks x strategies), in tiles of 256 strategies; the tiles of some splits meet for the best strategy and the median, as
    many splits as fit one task.  The splits are a fixed list given by ``n_subsets`` alone.

    Returns that are null or not finite are left out.  A strategy may have no returns in some blocks: a half with fewer
    than two returns has a Sharpe ratio of 0.  With fewer than two strategies nothing can be compared, and the result is
    one row with n_combinations 0 and nulls.
    """
    value = F.col(ret)
    returns = returns.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    returns = returns.select(F.col(t).alias("_t"), STRATEGY, value.cast("double").alias("_x"))
    numbers = numbered(returns.select("_t").distinct(), ["_t"], "_pos")
    length = numbers.count() // n_subsets
    rows = returns.join(numbers, "_t").withColumn("_block", F.floor(F.col("_pos") / max(length, 1)).cast("int"))
    blocks = rows.where((F.lit(length) >= 4) & (F.col("_block") < n_subsets)).groupBy(STRATEGY, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.var_pop("_x").alias("var")
    )
    # one short array (n_subsets entries) per strategy
    per_strategy = stage(blocks.groupBy(STRATEGY).agg(F.collect_list(F.struct("_block", "n", "mean", "var")).alias("_b")), "block-returns")
    n_strategies = per_strategy.count()
    half = n_subsets // 2
    splits = [m for m in range(2**n_subsets) if m.bit_count() == half]
    width = max(1, min(len(splits), _CELLS // max(n_strategies, 1)))
    kind = per_strategy.schema[STRATEGY].dataType
    schema = T.StructType().add("part", "integer").add("best", T.ArrayType(T.DoubleType())).add("name", T.ArrayType(kind)).add("out", "binary")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        chosen = (np.array(splits)[:, None] >> np.arange(n_subsets)) & 1
        for batch in batches:
            for some in range(0, batch.num_rows, _TILE):
                held = sorted(batch.slice(some, _TILE).to_pylist(), key=lambda r: r[STRATEGY])
                table = np.zeros((3, n_subsets, len(held)))
                for i, row in enumerate(held):
                    for b in row["_b"]:
                        table[:, b["_block"], i] = b["n"], b["mean"], b["var"]
                for part in range(0, len(splits), width):
                    inside = chosen[part : part + width].astype(float)
                    sharpe_in, sharpe_out = (_half_sharpe(m, *table) * math.sqrt(periods) for m in (inside, 1 - inside))
                    top = sharpe_in.argmax(axis=1)
                    at = np.arange(len(top)), top
                    # The best strategy of the tile first, then all.
                    out = np.column_stack([sharpe_out[at], sharpe_out])
                    values = [part // width, sharpe_in[at].tolist(), [held[k][STRATEGY] for k in top], out.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def deltas(group: pa.Table) -> pa.Table:
        best = np.array(group.column("best").to_pylist())
        names = group.column("name").to_pylist()
        outs = [np.frombuffer(o, float).reshape(best.shape[1], -1) for o in group.column("out").to_pylist()]
        median = np.median(np.column_stack([o[:, 1:] for o in outs]), axis=1)
        # Ties in sample go to the lowest strategy.
        winner = [min(np.flatnonzero(best[:, k] == best[:, k].max()), key=lambda i: names[i][k]) for k in range(best.shape[1])]
        return pa.table({"delta": [outs[i][k, 0] - median[k] for k, i in enumerate(winner)]})

    compared = per_strategy.where(F.lit(n_strategies >= 2)).mapInArrow(tiles, schema).groupBy("part").applyInArrow(deltas, "delta double")
    clipped = F.least(F.greatest("pbo", F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        compared.agg(
            rate(F.col("delta") < 0).alias("pbo"),
            F.percentile("delta", F.lit(0.5)).alias("median_oos_delta_sr"),
            F.count(F.lit(1)).alias("n_combinations"),
        )
        .withColumn("logit_pbo", F.log(clipped / (1.0 - clipped)))
        .withColumn("is_overfit", F.col("pbo") > 0.5)
    )


def _half_sharpe(inside: np.ndarray, n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Mean over deviation of the blocks that ``inside`` (splits x blocks) takes, for the strategies of a tile (blocks x strategies)."""
    centre = (n * mean).sum(axis=0) / np.maximum(n.sum(axis=0), 1)
    off = mean - centre
    count, total, square = inside @ n, inside @ (n * off), inside @ (n * (var + off * off))
    enough = count >= 2
    count = np.where(enough, count, 2)
    sd = np.sqrt(np.maximum(square - total * total / count, 0) / (count - 1))
    usable = enough & (sd >= 1e-12)
    return np.where(usable, (centre + total / count) / np.where(usable, sd, 1), 0.0)


def regime_breakdown(
    trades: DataFrame, regime: str = "regime", pnl: str = "net_pnl", notional: str = "notional", periods: int = YEAR,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Trades, win rate, mean, deviation, Sharpe ratio and annual return per regime."""
    if regime not in trades.columns:
        trades = trades.withColumn(regime, F.lit("unknown"))
    return (
        trades.withColumn("_ret", F.col(pnl) / F.greatest(F.col(notional), F.lit(1.0)))
        .groupBy(*keys, F.col(regime).alias("regime"))
        .agg(
            F.count(F.lit(1)).alias("n_trades"),
            rate(F.col(pnl) > 0).alias("win_rate"),
            F.avg("_ret").alias("mean_ret"),
            F.stddev_samp("_ret").alias("std_ret"),
        )
        .withColumn("sharpe", F.col("mean_ret") / F.when(F.col("std_ret").isNotNull(), F.greatest("std_ret", F.lit(1e-10))) * math.sqrt(periods))
        .withColumn("ann_return", F.col("mean_ret") * periods)
    )


def strategy_candidates(
    returns: DataFrame, cost_bps: float = 5.0, multipliers: Sequence[float] = MULTIPLIERS, t: str = "day"
) -> DataFrame:
    """Scaled variants of a return series, each with its cost drag: (t, strategy_id, ret)."""
    variants = [
        F.struct(
            F.lit(i).alias(STRATEGY),
            (F.col("ret") * m - (m - 1.0) * (cost_bps / 10_000.0) * 0.05).alias("ret"),
        )
        for i, m in enumerate(multipliers)
    ]
    return returns.select(F.col(t).alias("t"), F.inline(F.array(*variants)))


def _long(df: DataFrame, section: str, metrics: Sequence[str], who: Column, suffix: Column | None = None) -> DataFrame:
    name = lambda m: F.concat(F.lit(f"{m}_"), suffix) if suffix is not None else F.lit(m)
    cells = [F.struct(name(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(who.cast("string").alias(STRATEGY), F.lit(section).alias("section"), F.inline(F.array(*cells)))


def evaluation_report(
    summary: DataFrame,
    returns: DataFrame,
    trades: DataFrame,
    n_trials: int,
    returns_matrix: DataFrame | None = None,
    n_subsets: int = 4,
) -> DataFrame:
    """All statistics in long form: (strategy_id, section, metric, value)."""
    parts = [
        _long(
            summary,
            "basic",
            ["sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "win_rate", "n_trades", "total_return"],
            F.col(STRATEGY),
        ),
        _long(
            deflated_sharpe(returns, n_trials),
            "deflated_sharpe",
            ["sr", "sr_per_period", "psr", "dsr", "e_max_sr", "skewness", "excess_kurtosis", "is_significant"],
            F.col(STRATEGY),
        ),
        _long(
            regime_breakdown(trades, keys=[STRATEGY]),
            "regime",
            ["n_trades", "win_rate", "mean_ret", "std_ret", "sharpe", "ann_return"],
            F.col(STRATEGY),
            F.col("regime").cast("string"),
        ),
    ]
    # One strategy alone cannot be overfitted against others.
    if returns_matrix is not None and returns_matrix.select(STRATEGY).distinct().limit(2).count() == 2:
        parts.append(
            _long(
                overfitting_probability(returns_matrix, n_subsets),
                "overfitting",
                ["pbo", "logit_pbo", "median_oos_delta_sr", "n_combinations", "is_overfit"],
                F.lit("all"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Market regime: cross-sectional inputs and walk-forward mixture labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.functions.exprs import rolling
from causalbars.plans.series import SeriesSpec, asof_join, global_position, running_totals
from causalbars.plans.staging import stage

# Regime window, minimum history, number of regimes.
REGIME_WINDOW = 60
REGIME_MIN_ROWS = 30
N_REGIMES = 3


def _grid(df: DataFrame) -> DataFrame:
    """Number the distinct timestamps 0, 1, 2, ... in time order."""
    return global_position(df.select("timestamp").distinct(), "timestamp", ["timestamp"], "g")


def cross_section_of_rolling(
    df: DataFrame, value: str, stat, name: str, window: int, min_count: int, rows_per_block: int = 250_000
) -> DataFrame:
    """Mean over tickers of a rolling statistic on the common timestamp grid.

    The statistic runs over the last ``window`` grid steps; a ticker that has no row
    at a step still contributes while it has ``min_count`` values in reach.  A ticker's statistic
    changes only where one of its rows enters or leaves the window, so each row brings two change points, and the
    cross-section is the running total of their differences.  A value that is not finite makes the mean NaN while it is in reach.
    """
    points = df.where(F.col(value).isNotNull()).select("ticker", "timestamp", F.col(value).alias("_x"))
    grid = stage(_grid(points), "grid")
    size = max(rows_per_block, 2 * window)
    home = F.floor(F.col("g") / size)
    placed = (
        points.join(grid, "timestamp")
        .drop("timestamp")
        .withColumn("_block", F.explode(F.sequence(home, F.floor((F.col("g") + 2 * window) / size))))
    )
    enters, leaves = F.struct("g", "_x"), F.struct((F.col("g") + window).alias("g"), F.lit(None).cast("double").alias("_x"))
    changes = placed.select("ticker", "_block", F.inline(F.array(enters, leaves)))
    by_block = Window.partitionBy("ticker", "_block").orderBy("g")
    odd = F.isnan("_r") | (F.abs("_r") == float("inf"))
    now = F.struct(
        F.when(~odd, F.col("_r")).otherwise(0.0).alias("r"),
        F.when(F.col("_r").isNotNull(), 1).otherwise(0).alias("n"),
        F.when(odd, 1).otherwise(0).alias("odd"),
    )
    before = F.lag("_now").over(by_block)
    moved = (
        changes.withColumn("_r", rolling(stat, "_x", by_block.rangeBetween(-(window - 1), 0), min_count))
        .withColumn("_now", now)
        .withColumn("_before", before)
        .where(F.floor(F.col("g") / size) == F.col("_block"))
    )
    deltas = moved.groupBy("g").agg(
        *[F.sum(F.col(f"_now.{c}") - F.coalesce(F.col(f"_before.{c}"), F.lit(0))).alias(c) for c in ("r", "n", "odd")]
    )
    # Stored: a few numbers for each step of the grid, which the totals read twice, and each read would roll again over all rows.
    totals = running_totals(stage(deltas, "deltas"), "g", ["r", "n", "odd"], bucket=F.floor(F.col("g") / 4096))
    mean = F.when(F.col("odd_cum") > 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("r_cum"), F.col("n_cum")))
    return grid.join(totals, "g").select("timestamp", mean.alias(name))


def regime_inputs(features: DataFrame, window: int = REGIME_WINDOW, min_count: int = REGIME_MIN_ROWS) -> DataFrame:
    """Per timestamp the mean rolling volatility and the mean rolling return deviation."""
    vol = cross_section_of_rolling(features, "realized_vol", F.avg, "mean_vol", window, min_count)
    dev = cross_section_of_rolling(features, "log_return", F.stddev_samp, "mean_corr_proxy", window, min_count)
    return vol.join(dev, "timestamp").dropna()


@dataclass
class Mixture:
    """A mixture of normals in two dimensions, by the sufficient statistics of what it has seen.

    ``totals`` (components x 6) are sums of weight, w*x, w*y, w*x*x, w*x*y and w*y*y, where w is the share of a point that a component has.
    """

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    totals: np.ndarray

    def scores(self, x: str = "mean_vol", y: str = "mean_corr_proxy") -> list[Column]:
        """Log density of a point in each component, times its weight."""
        out = []
        for w, (mx, my), cov in zip(self.weights, self.means, self.covs, strict=True):
            (a, b), (_, d) = np.linalg.inv(cov)
            dx, dy = F.col(x) - F.lit(float(mx)), F.col(y) - F.lit(float(my))
            level = float(np.log(max(w, 1e-300)) - 0.5 * np.log(np.linalg.det(cov)))
            out.append(F.lit(level) - 0.5 * (float(a) * dx * dx + 2 * float(b) * dx * dy + float(d) * dy * dy))
        return out

    def label(self) -> Column:
        """Number of the likeliest component, in the order of mean volatility."""
        order = [int(k) for k in np.argsort(np.argsort(self.means[:, 0], kind="stable"), kind="stable")]
        scores = F.array(*self.scores())
        best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
        return F.get(F.array(*[F.lit(k).cast("long") for k in order]), best)

    def shares(self, rows: DataFrame) -> np.ndarray:
        """Sufficient statistics of ``rows`` under the present parameters: one aggregate, some numbers for each component."""
        scores = self.scores()
        rows = rows.select("mean_vol", "mean_corr_proxy", F.array(*scores).alias("_l")).withColumn("_most", F.array_max("_l"))
        rows = rows.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.col("_most"))))
        rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, v: s + v))
        x, y, sums = F.col("mean_vol"), F.col("mean_corr_proxy"), []
        for k in range(len(scores)):
            w = F.get("_e", F.lit(k)) / F.col("_sum")
            sums += [F.sum(w * m) for m in (F.lit(1.0), x, y, x * x, x * y, y * y)]
        return np.array([v or 0.0 for v in rows.agg(*sums).first()]).reshape(-1, 6)

    def having_seen(self, totals: np.ndarray) -> Mixture:
        """Parameters from these statistics; a component that has less than two points keeps its place."""
        means, covs = self.means.copy(), self.covs.copy()
        for k, (n, x, y, xx, xy, yy) in enumerate(totals):
            if n >= 2:
                means[k] = x / n, y / n
                mx, my = means[k]
                covs[k] = [[xx / n - mx * mx, xy / n - mx * my], [xy / n - mx * my, yy / n - my * my]]
                covs[k] += np.eye(2) * 1e-6 * max(covs[k].trace(), 1e-12)
        return Mixture(totals[:, 0] / totals[:, 0].sum(), means, covs, totals)


def first_mixture(train: DataFrame, n_rows: int, n_regimes: int, seed: int) -> Mixture:
    """A mixture fitted from nothing, on standardized inputs."""
    assembled = VectorAssembler(inputCols=["mean_vol", "mean_corr_proxy"], outputCol="_raw").transform(train)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(assembled)
    # Spark's tolerance is on the whole log-likelihood; ask for 0.001 per row
    model = GaussianMixture(featuresCol="_x", k=n_regimes, seed=seed, tol=1e-3 * n_rows).fit(scaler.transform(assembled))
    centre, scale = scaler.mean.toArray(), np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0)
    means = np.array([g.mean.toArray() * scale + centre for g in model.gaussians])
    covs = np.array([g.cov.toArray() * np.outer(scale, scale) + np.diag(scale**2) * 1e-6 for g in model.gaussians])
    return Mixture(np.array(model.weights), means, covs, np.zeros((n_regimes, 6)))


def regime_labels(
    features: DataFrame,
    n_regimes: int = N_REGIMES,
    window: int = REGIME_WINDOW,
    min_count: int = REGIME_MIN_ROWS,
    strict: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Walk-forward regime per timestamp: (timestamp, regime).

    Timestamps are labelled in at most 21 chunks, each by a mixture of those before it.  The first chunk is labelled by a fit on its own
    first rows, or 0 if ``strict``; a second fit takes the whole first chunk.  From then on the mixture is carried along: a chunk, once
    labelled, adds its sufficient statistics to those of all chunks before, which gives the parameters for the next.  So every chunk is
    read once more after its labelling, and history is never read again.  Components are numbered by mean volatility.
    Timestamps without inputs carry the last regime forward, 0 at the start.
    """
    inputs = stage(
        global_position(regime_inputs(features, window, min_count), "timestamp", ["timestamp"]), "regime-inputs"
    )
    n = inputs.count()
    step = max(200, n // 20)
    mixture, parts = None, []
    for start in range(0, n, step):
        chunk = inputs.where((F.col("pos") >= start) & (F.col("pos") < start + step))
        if n < min_count or (strict and start == 0):
            parts.append(chunk.select("timestamp", F.lit(0).cast("long").alias("regime")))
            continue
        if start == 0:
            labelling = first_mixture(inputs.where(F.col("pos") < min_count), min_count, n_regimes, seed)
        elif mixture is None:
            first = inputs.where(F.col("pos") < start)
            mixture = first_mixture(first, start, n_regimes, seed)
            labelling = mixture = mixture.having_seen(mixture.shares(first))
        else:
            last = inputs.where((F.col("pos") >= start - step) & (F.col("pos") < start))
            labelling = mixture = mixture.having_seen(mixture.totals + mixture.shares(last))
        parts.append(chunk.select("timestamp", labelling.label().alias("regime")))
    steps = features.where(F.col("realized_vol").isNotNull()).select("timestamp").distinct()
    if not parts:
        return steps.withColumn("regime", F.lit(0).cast("long"))
    known = parts[0]
    for part in parts[1:]:
        known = known.unionByName(part)
    spec = SeriesSpec(keys=("_market",))
    return (
        asof_join(
            steps.withColumn("_market", F.lit(0)),
            known.withColumn("_market", F.lit(0)),
            F.col("regime"),
            "regime",
            "timestamp",
            spec=spec,
        )
        .drop("_market")
        .fillna(0, ["regime"])
    )

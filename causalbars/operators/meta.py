"""Meta-labels: when is the primary forecast worth acting on?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.functions.exprs import preceding, rolling
from causalbars.operators.cv import fit_folds, stored_by_fold, test_rows, train_rows
from causalbars.plans.quantiles import cut_points, slice_of
from causalbars.plans.series import SeriesSpec, block_series, drop_internal, running_totals
from causalbars.plans.staging import stage

# Input columns of the act / skip classifier and the hit-rate window.
META_FEATURES = ("p50", "p10", "p90", "band_width", "regime", "recent_hit_rate", "vol_norm_return_lag1")
HIT_WINDOW = 20
HIT_MIN = 5

EVENTS = SeriesSpec(ts="t0", span_seconds=365 * 86_400)


def meta_label(cost_bps: float = 5.0, min_bps: float = 2.0) -> Column:
    """1 if the forecast has the right sign and the move beats the costs."""
    ret = F.col("return_at_touch")
    right = F.signum("p50") == F.signum(ret)
    return (right & (F.abs(ret) > cost_bps / 10_000.0 + min_bps / 10_000.0)).cast("int")


def band_width(columns: Sequence[str]) -> Column:
    """Width of the calibrated band, else of the raw one, else 1."""
    if {"p10_adj", "p90_adj"} <= set(columns):
        return F.col("p90_adj") - F.col("p10_adj")
    if {"p10", "p90"} <= set(columns):
        return F.col("p90") - F.col("p10")
    return F.lit(1.0)


def build_meta_labels(
    predicted: DataFrame,
    cost_bps: float = 5.0,
    min_bps: float = 2.0,
    resolved_only: bool = False,
    spec: SeriesSpec = EVENTS,
) -> DataFrame:
    """Meta-label, band width, recent hit rate and lagged return per event.

    The hit rate averages the ticker's previous 20 events (5 needed, else 0.5).  Some
    of those may end after t0; ``resolved_only`` leaves them out.
    """
    df = predicted.withColumn("band_width", band_width(predicted.columns)).withColumn(
        "meta_label", meta_label(cost_bps, min_bps)
    )
    blocks = block_series(df, HIT_WINDOW, spec=spec)
    w = blocks.window()
    df = blocks.df
    if resolved_only:
        past = F.collect_list(F.struct("t1", F.col("meta_label").alias("hit"))).over(preceding(w, HIT_WINDOW))
        df = df.withColumn("_past", past).withColumn("_past", F.filter("_past", lambda e: e["t1"] <= F.col("t0")))
        hits = F.aggregate("_past", F.lit(0.0), lambda acc, e: acc + e["hit"])
        df = df.withColumn("recent_hit_rate", F.when(F.size("_past") >= HIT_MIN, hits / F.size("_past"))).drop("_past")
    else:
        df = df.withColumn("recent_hit_rate", rolling(F.avg, "meta_label", preceding(w, HIT_WINDOW), HIT_MIN))
    lagged = F.lag("vol_norm_return").over(w) if "vol_norm_return" in predicted.columns else F.lit(0.0)
    df = df.withColumn("vol_norm_return_lag1", lagged).where(blocks.own_rows())
    return drop_internal(df).fillna({"recent_hit_rate": 0.5, "vol_norm_return_lag1": 0.0})


class MetaClassifier:
    """Act / skip boosted trees under purged folds."""

    def __init__(
        self,
        features: Sequence[str] = META_FEATURES,
        n_trees: int = 200,
        max_depth: int = 4,
        seed: int = 42,
        weight: str | None = "sample_weight",
        holdout: float = 0.1,
        parallel: int = 5,
    ):
        self.features, self.n_trees, self.max_depth = list(features), n_trees, max_depth
        self.seed, self.weight, self.holdout, self.parallel = seed, weight, holdout, parallel
        self.models: list = []

    def _assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features").transform(df)

    def fit(self, folds: DataFrame, n_splits: int, label: str = "meta_label") -> DataFrame:
        """Fit one model per fold, side by side; returns test rows with ``proba`` and ``prediction``.

        Early stopping watches the tail of the *training* rows, never the test fold.
        Positives weigh ``max(1, negatives / positives)``.  The rows are stored by fold, and each fit reads its own.
        """
        columns = [c for c in self.features if c in folds.columns]
        self.features = columns
        rows = self._assemble(stored_by_fold(folds.dropna(subset=[*columns, label]))).withColumn("_y", F.col(label).cast("double"))
        booster = GBTClassifier(
            featuresCol="_features",
            labelCol="_y",
            weightCol="_fit_weight",
            validationIndicatorCol="_holdout",
            maxIter=self.n_trees,
            maxDepth=self.max_depth,
            stepSize=0.05,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            seed=self.seed,
            predictionCol="_pred",
        )
        booster = booster.setProbabilityCol("_proba").setRawPredictionCol("_raw")

        def fit_one(k: int):
            train = train_rows(rows, k)
            stats = train.agg(
                F.count_if(F.col("_y") == 0),
                F.count_if(F.col("_y") == 1),
                F.min("pos"),
                F.max("pos"),
                F.avg(self.weight) if self.weight else F.lit(1.0),
            ).first()
            positive = max(1.0, stats[0] / max(stats[1], 1))
            cut = stats[3] - self.holdout * (stats[3] - stats[2])
            weight = F.when(F.col("_y") == 1, positive).otherwise(1.0)
            if self.weight:
                weight = weight * F.col(self.weight) / (stats[4] or 1.0)
            return booster.fit(train.withColumn("_fit_weight", weight).withColumn("_holdout", F.col("pos") > cut))

        self.models = fit_folds(fit_one, n_splits, self.parallel)
        parts = [self._score(model, test_rows(rows, k)) for k, model in enumerate(self.models)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.withColumn("prediction", (F.col("proba") >= 0.5).cast("int")).drop("_features", "_y")

    def _score(self, model, df: DataFrame) -> DataFrame:
        return (
            model.transform(df)
            .withColumn("proba", F.get(vector_to_array("_proba"), F.lit(1)))
            .drop("_raw", "_proba", "_pred")
        )

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Mean probability over the fold models; ``meta_decision`` is 1 at the threshold."""
        if not self.models:
            raise RuntimeError("fit() comes first")
        rows = self._assemble(df.fillna(0, self.features))
        for i, model in enumerate(self.models):
            rows = self._score(model, rows).withColumnRenamed("proba", f"_p{i}")
        members = [f"_p{i}" for i in range(len(self.models))]
        return mean_decision(rows, members, threshold).drop("_features", *members)


def mean_decision(df: DataFrame, members: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``meta_proba``: mean of the members; ``meta_decision``: 1 from the threshold on."""
    mean = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    return df.withColumn("meta_proba", mean).withColumn(
        "meta_decision", (F.col("meta_proba") >= threshold).cast("int")
    )


def binary_metrics(
    predicted: DataFrame, label: str = "meta_label", score: str = "proba", threshold: float = 0.5,
    keys: Sequence[str] = ("fold",),
) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC and act rate per fold.

    AUC by rank sums: rows are first counted per distinct score, then running
    totals over score slices give the negatives below each score; ties count half.
    AUC is null when a fold has one class only.
    """
    keys = list(keys)
    act = F.col(score) >= threshold
    pos = F.col(label) == 1
    tp, fp = F.count_if(act & pos), F.count_if(act & ~pos)
    per_fold = predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((act == pos).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.count_if(pos)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, F.count_if(act) + F.count_if(pos)), F.lit(0.0)).alias("f1"),
        F.avg(act.cast("double")).alias("act_rate"),
    )
    scores = predicted.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(pos).alias("_pos"), F.count_if(~pos).alias("_neg")
    )
    # Approximate: stored, so that every read sees the same slices.
    cuts = stage(predicted.agg(F.percentile_approx(score, cut_points(256), 4000)), "cuts").scalar()
    scores = scores.withColumn("_cuts", cuts).withColumn("_slice", slice_of(F.col("_s"), "_cuts")).drop("_cuts")
    ranked = running_totals(scores, "_s", ["_neg"], keys, bucket=F.col("_slice"))
    below = F.col("_neg_cum") - F.col("_neg") / 2.0
    auc = ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_pos") * below), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc_roc")
    )
    return per_fold.join(auc, keys)

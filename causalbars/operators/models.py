"""Primary models: tree ensemble, quantile forecasts, metrics, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.operators.cv import fit_folds, stored_by_fold, test_rows, train_rows
from causalbars.plans.quantiles import exact_quantiles

# Input columns of the baseline classifier, classes, quantile levels.
BASELINE_FEATURES = (
    "momentum_5",
    "momentum_20",
    "momentum_60",
    "rsi_14",
    "hl_spread",
    "z_price",
    "realized_vol",
    "weighted_sentiment",
    "sentiment_count",
    "max_credibility",
    "regime",
    "adv",
)
CLASSES = (-1, 0, 1)
QUANTILES = {"p10": 0.10, "p50": 0.50, "p90": 0.90}


def join_features(labels: DataFrame, features: DataFrame, columns: Sequence[str] = BASELINE_FEATURES) -> DataFrame:
    """Labels with the features at (ticker, t0); rows missing any feature are left out."""
    at = features.select("ticker", F.col("timestamp").alias("t0"), *columns)
    return labels.drop(*columns).join(at, ["ticker", "t0"], "left").dropna(subset=list(columns))


def argmax_class(probabilities: Column, classes: Sequence[int] = CLASSES) -> Column:
    """The class with the largest probability, the first one on ties."""
    values = F.array(*[F.lit(c) for c in classes])
    return F.get(values, F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1)


def _balanced(train: DataFrame, label: str, weight: str | None) -> DataFrame:
    """Weight every class alike: n / (classes * n_class), times the row's weight."""
    per_class = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))  # at most three rows
    totals = per_class.agg(F.sum("_nc"), F.count(F.lit(1))).first()
    n, k = (totals[0] or 0), max(totals[1], 1)
    balanced = train.join(F.broadcast(per_class), label).withColumn("_fit_weight", n / (k * F.col("_nc")))
    if weight:
        # Tree learners compare weights with fixed thresholds: keep the mean near one.
        mean = train.agg(F.avg(weight)).first()[0] or 1.0
        balanced = balanced.withColumn("_fit_weight", F.col("_fit_weight") * F.col(weight) / mean)
    return balanced.drop("_nc")


class BaselineClassifier:
    """Three-class forest under purged folds, with out-of-fold probabilities."""

    def __init__(
        self,
        features: Sequence[str] = BASELINE_FEATURES,
        n_trees: int = 200,
        max_depth: int = 5,
        seed: int = 42,
        weight: str | None = "sample_weight",
        parallel: int = 5,
    ):
        self.features, self.n_trees, self.max_depth = list(features), n_trees, max_depth
        self.seed, self.weight, self.parallel = seed, weight, parallel
        self.models: list = []

    def _assemble(self, df: DataFrame) -> DataFrame:
        assembler = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep")
        return assembler.transform(df)

    def fit(self, folds: DataFrame, n_splits: int, label: str = "label") -> DataFrame:
        """Fit one forest per fold, side by side; returns test rows with ``proba`` and ``prediction``.

        The rows are stored by fold, and each fit reads its own.
        """
        rows = self._assemble(stored_by_fold(folds)).withColumn("_y", (F.col(label) + 1).cast("double"))
        forest = RandomForestClassifier(
            featuresCol="_features",
            labelCol="_y",
            weightCol="_fit_weight",
            numTrees=self.n_trees,
            maxDepth=self.max_depth,
            seed=self.seed,
            probabilityCol="_proba",
            predictionCol="_pred",
            rawPredictionCol="_raw",
        )
        self.models = fit_folds(lambda k: forest.fit(_balanced(train_rows(rows, k), "_y", self.weight)), n_splits, self.parallel)
        parts = [self._score(model, test_rows(rows, k)) for k, model in enumerate(self.models)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.withColumn("prediction", argmax_class(F.col("proba"))).drop("_features", "_y")

    def _score(self, model, df: DataFrame) -> DataFrame:
        # A class no training row of the fold had has probability zero.  The forest stands once in the expression, not inside a
        # lambda, which would ask it again for each class.
        zeros = F.array_repeat(F.lit(0.0), F.lit(len(CLASSES)))
        padded = F.slice(F.concat(vector_to_array("_proba"), zeros), 1, len(CLASSES))
        return model.transform(df).withColumn("proba", padded).drop("_raw", "_proba", "_pred")

    def predict(self, df: DataFrame) -> DataFrame:
        """Mean probability over the fold models and the decoded class."""
        if not self.models:
            raise RuntimeError("fit() comes first")
        rows = self._assemble(df)
        for i, model in enumerate(self.models):
            rows = self._score(model, rows).withColumnRenamed("proba", f"_p{i}")
        members = [f"_p{i}" for i in range(len(self.models))]
        return with_ensemble(rows, members).drop("_features", *members)

    def feature_importance(self, df: DataFrame) -> DataFrame:
        """(feature, importance) averaged over the folds, largest first."""
        if not self.models:
            raise RuntimeError("fit() comes first")
        rows = [
            (name, float(model.featureImportances[i])) for model in self.models for i, name in enumerate(self.features)
        ]
        table = df.sparkSession.createDataFrame(rows, "feature string, importance double")  # features x folds
        return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
            F.desc("importance"), "feature"
        )


def with_ensemble(df: DataFrame, members: Sequence[str], classes: Sequence[int] = CLASSES) -> DataFrame:
    """``proba``: element-wise mean of the members' probability arrays; ``prediction``: its class."""
    total = F.col(members[0])
    for m in members[1:]:
        total = F.zip_with(total, F.col(m), lambda a, b: a + b)
    proba = F.transform(total, lambda p: p / len(members))
    return df.withColumn("proba", proba).withColumn("prediction", argmax_class(F.col("proba"), classes))


def multiclass_metrics(
    predicted: DataFrame, label: str = "label", proba: str = "proba", keys: Sequence[str] = ("fold",)
) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall of the classes present) and log loss."""
    y, hit = F.col(label), F.col("prediction") == F.col(label)
    p_true = F.get(F.col(proba), (y + 1).cast("int")) / F.aggregate(F.col(proba), F.lit(0.0), lambda a, p: a + p)
    eps = 2.220446049250313e-16
    recalls = [F.try_divide(F.count_if(hit & (y == c)), F.count_if(y == c)) for c in CLASSES]
    present = sum((F.coalesce(F.signum(F.count_if(y == c)), F.lit(0.0)) for c in CLASSES), F.lit(0.0))
    recall_sum = sum((F.coalesce(r, F.lit(0.0)) for r in recalls), F.lit(0.0))
    return predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.try_divide(recall_sum, present).alias("bal_accuracy"),
        F.avg(-F.log(F.least(F.greatest(p_true, F.lit(eps)), F.lit(1.0 - eps)))).alias("log_loss"),
    )


def fold_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The folds' rows and one more, ``mean``, with their averages."""
    means = per_fold.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("mean").alias("fold"), *metrics)
    rows = per_fold.select(F.col("fold").cast("string"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return rows.unionByName(means)


def quantile_forecast(
    train: DataFrame, test: DataFrame, target: str, cells: Sequence[Sequence[str]], min_rows: int = 20
) -> DataFrame:
    """P10 / P50 / P90 of the training target in the finest cell with enough rows.

    ``cells`` lists column sets from fine to coarse, the last usually empty (all rows).
    Quantiles of one sample never cross.
    """
    out = test
    levels = {q: F.lit(p) for q, p in QUANTILES.items()}
    names = list(QUANTILES)
    for i, columns in enumerate(cells):
        table = exact_quantiles(train, list(columns), target, levels)
        if columns:
            table = table.where(F.col("n") >= min_rows)
            table = table.select(*columns, F.struct(*names).alias(f"_q{i}"))
            out = out.join(table, list(columns), "left")
        else:
            out = out.withColumn(f"_q{i}", table.select(F.struct(*names)).scalar())
    pick = F.coalesce(*[F.col(f"_q{i}") for i in range(len(cells))])
    return out.withColumns({q: pick[q] for q in names}).drop(*[f"_q{i}" for i in range(len(cells))])


def signal_decile(df: DataFrame, signal: str, cuts: DataFrame, name: str = "decile") -> DataFrame:
    """Decile number of ``signal`` by a one-row table of its nine cut points (d1..d9)."""
    points = cuts.select(F.array(*[f"d{i}" for i in range(1, 10)])).scalar()
    return df.withColumn("_cuts", points).withColumn(
        name, F.size(F.filter("_cuts", lambda c: c < F.col(signal)))
    ).drop("_cuts")


def decile_cuts(train: DataFrame, signal: str) -> DataFrame:
    return exact_quantiles(train, [], signal, {f"d{i}": F.lit(i / 10) for i in range(1, 10)})


def _pinball(y: Column, pred: Column, q: float) -> Column:
    err = y - pred
    return F.when(err >= 0, q * err).otherwise((q - 1.0) * err)


def pinball_loss(df: DataFrame, target: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss per quantile and, as ``pinball_loss``, over the three."""
    w = F.col(weight) if weight else F.lit(1.0)
    losses = [F.avg(_pinball(F.col(target), F.col(c), q) * w).alias(f"loss_{c}") for c, q in QUANTILES.items()]
    out = df.groupBy(*keys).agg(*losses)
    return out.withColumn("pinball_loss", sum((F.col(f"loss_{c}") for c in QUANTILES), F.lit(0.0)) / len(QUANTILES))


def quantile_crossing(df: DataFrame) -> DataFrame:
    """(n, crossings): rows whose quantiles are out of order."""
    crossed = (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(crossed).alias("crossings"))


def score_sequences(
    sequences: DataFrame,
    load_model: Callable[[], Callable],
    key: Sequence[str] = ("ticker", "t0"),
    column: str = "sequence",
) -> DataFrame:
    """Score sequences with an externally trained model: key columns + p10, p50, p90.

    ``load_model`` runs once per task and returns ``f(batch) -> (p10, p50, p90)``,
    where a batch is an array of shape (rows, steps, features).
    """
    import numpy as np
    import pandas as pd

    rows = sequences.select(*key, column)
    schema = T.StructType(
        [*[f for f in rows.schema.fields if f.name in key], *[T.StructField(q, T.DoubleType()) for q in QUANTILES]]
    )
    names = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for batch in batches:
            if batch.empty:
                continue
            predict = predict or load_model()
            cube = np.stack([np.stack(s) for s in batch[column]])
            p10, p50, p90 = predict(cube)
            yield batch[names].assign(p10=p10, p50=p50, p90=p90)

    return rows.mapInPandas(run, schema)

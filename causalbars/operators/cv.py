"""Purged, embargoed K-fold validation over the global time order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.plans.series import global_position
from causalbars.plans.staging import stage

Fitted = TypeVar("Fitted")
FoldFunction = Callable[[DataFrame, DataFrame], DataFrame]


def _check(n_splits: int, embargo_pct: float) -> None:
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    if not 0.0 <= embargo_pct < 0.5:
        raise ValueError("embargo_pct must be in [0, 0.5)")


def fold_of(pos: Column, n: Column, n_splits: int) -> Column:
    """Contiguous folds of nearly equal size, the longer ones first."""
    size = F.floor(n / n_splits)
    longer = n % n_splits
    head = longer * (size + 1)
    return F.when(pos < head, F.floor(pos / (size + 1))).otherwise(
        longer + F.floor((pos - head) / F.greatest(size, F.lit(1)))
    ).cast("int")


def with_folds(
    df: DataFrame, n_splits: int = 5, t0: str = "t0", ties: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Add ``pos``, the place in the order (t0, ties), ``n`` and ``own_fold``."""
    placed = global_position(df, t0, list(ties)).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    return placed.withColumn("own_fold", fold_of(F.col("pos"), F.col("n"), n_splits))


def purged_folds(
    df: DataFrame,
    n_splits: int = 5,
    embargo_pct: float = 0.01,
    mode: str = "strict",
    t0: str = "t0",
    t1: str = "t1",
    ties: Sequence[str] = ("ticker",),
) -> DataFrame:
    """Every row once per fold with its role: test, train, purged or embargo.

    ``strict`` purges each training row whose window meets the test fold's window
    span.  ``compat`` purges only rows before the fold that end at or after the
    t1 of the row just before it.  The embargo then takes the next
    ``ceil(embargo_pct * n)`` positions.  Stage ``df`` first if it is costly: the
    fold bounds and the positions are taken from it.
    """
    _check(n_splits, embargo_pct)
    if mode not in ("strict", "compat"):
        raise ValueError("mode must be 'strict' or 'compat'")
    if t1 not in df.columns:
        raise ValueError(f"purging needs the label end times in column {t1!r}")
    rows = with_folds(df, n_splits, t0, ties)
    by_fold = Window.partitionBy(F.lit(0)).orderBy("fold")  # n_splits rows
    bounds = (
        rows.groupBy(F.col("own_fold").alias("fold"))
        .agg(
            F.min("pos").alias("_start"),
            F.max("pos").alias("_end"),
            F.min(t0).alias("_t0_min"),
            F.max(F.greatest(t0, t1)).alias("_span_end"),
            F.max_by(t1, "pos").alias("_last_t1"),
        )
        .withColumn("_threshold", F.lag("_last_t1").over(by_fold))
        .drop("_last_t1")
    )
    # n_splits rows, whatever the size of the data
    every = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).join(
        F.broadcast(bounds), "fold"
    )
    pos = F.col("pos")
    embargo = F.ceil(F.lit(float(embargo_pct)) * F.col("n"))
    if mode == "compat":
        purge = (pos < F.col("_start")) & (F.col(t1) >= F.col("_threshold"))
    else:
        purge = (F.col(t0) <= F.col("_span_end")) & (F.col(t1) >= F.col("_t0_min"))
    role = (
        F.when(F.col("own_fold") == F.col("fold"), "test")
        .when((pos > F.col("_end")) & (pos <= F.col("_end") + embargo), "embargo")
        .when(F.coalesce(purge, F.lit(False)), "purged")
        .otherwise("train")
    )
    return every.withColumn("role", role).drop(
        "_start", "_end", "_t0_min", "_span_end", "_threshold", "own_fold", "n"
    )


def fold_sizes(folds: DataFrame) -> DataFrame:
    """Rows per role and fold; ``purged_count`` is everything but train and test."""
    is_role = {r: F.count_if(F.col("role") == r) for r in ("train", "test")}
    return folds.groupBy("fold").agg(
        is_role["train"].alias("train_size"),
        is_role["test"].alias("test_size"),
        (F.count(F.lit(1)) - is_role["train"] - is_role["test"]).alias("purged_count"),
    )


class PurgedFolds:
    """A reusable split definition."""

    def __init__(self, n_splits: int = 5, embargo_pct: float = 0.01, mode: str = "strict"):
        _check(n_splits, embargo_pct)
        self.n_splits, self.embargo_pct, self.mode = n_splits, embargo_pct, mode

    def get_n_splits(self) -> int:
        return self.n_splits

    def split(self, df: DataFrame, t0: str = "t0", t1: str = "t1", ties: Sequence[str] = ("ticker",)) -> DataFrame:
        return purged_folds(df, self.n_splits, self.embargo_pct, self.mode, t0, t1, ties)


def train_rows(folds: DataFrame, fold: int) -> DataFrame:
    return folds.where((F.col("fold") == fold) & (F.col("role") == "train"))


def test_rows(folds: DataFrame, fold: int) -> DataFrame:
    return folds.where((F.col("fold") == fold) & (F.col("role") == "test"))


def test_rows_of(folds: DataFrame) -> DataFrame:
    """Every row once, under the fold that tests it."""
    return folds.where(F.col("role") == "test")


def fit_folds(fit: Callable[[int], Fitted], n_splits: int, parallel: int = 5) -> list[Fitted]:
    """``fit(k)`` for every fold, at most ``parallel`` at a time, in the order of the folds.

    Threads of the driver submit the folds' jobs side by side, each in a pool of its own, which a session with the fair scheduler
    serves in turn (others in the order of submission).  A fit whose last stage leaves cores idle thus does not hold up the next.
    """
    context = SparkContext.getOrCreate()

    def one(k: int) -> Fitted:
        context.setLocalProperty("spark.scheduler.pool", f"fold-{k}")
        return fit(k)

    with ThreadPoolExecutor(max_workers=max(1, min(n_splits, parallel))) as threads:
        return list(threads.map(inheritable_thread_target(one), range(n_splits)))


def stored_by_fold(folds: DataFrame) -> DataFrame:
    """``folds`` written with a folder for each fold, so that a fit reads the rows of its own fold only."""
    return stage(folds, "folds", ["fold"])


def evaluate_folds(folds: DataFrame, n_splits: int, train_and_predict: FoldFunction) -> DataFrame:
    """Out-of-fold predictions of a user function ``(train, test) -> test + prediction``.

    The function receives DataFrames, so a fold's training set is never moved
    into one process; K calls build one plan whose branches Spark runs side by side.
    """
    parts = [train_and_predict(train_rows(folds, k), test_rows(folds, k)) for k in range(n_splits)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mean_model(target: str) -> FoldFunction:
    """The simplest learner: predict the training mean."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.withColumn("prediction", train.agg(F.avg(target)).scalar())

    return run


def fold_metrics(predicted: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row per fold with the given aggregates."""
    return predicted.groupBy("fold").agg(*[expr.alias(name) for name, expr in metrics.items()])


def fold_results(folds: DataFrame, per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One record per fold: train_size, test_size, purged_count and ``metrics`` as a map from name to value."""
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    return fold_sizes(folds).join(per_fold.select("fold", F.create_map(*pairs).alias("metrics")), "fold", "left")


def metric_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return per_fold.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    )


def assemble_oof(rows: DataFrame, predicted: DataFrame, key: Sequence[str] = ("ticker", "t0")) -> DataFrame:
    """All rows with their out-of-fold prediction (0 if uncovered) and ``oof_mask``."""
    hit = predicted.select(*key, F.col("prediction").alias("_p"), F.lit(True).alias("_hit"))
    return (
        rows.join(hit, list(key), "left")
        .withColumn("oof_prediction", F.coalesce("_p", F.lit(0.0)))
        .withColumn("oof_mask", F.coalesce("_hit", F.lit(False)))
        .drop("_p", "_hit")
    )


def calibration_split(folds: DataFrame, n_splits: int, key: Sequence[str] = ("ticker", "t0")) -> DataFrame:
    """Rows with ``part``: the last fold tests, the one before calibrates.

    Training rows are the last fold's, less the calibration rows.
    """
    test = test_rows(folds, n_splits - 1).withColumn("part", F.lit("test"))
    cal = test_rows(folds, n_splits - 2).withColumn("part", F.lit("calibration"))
    train = train_rows(folds, n_splits - 1).join(cal.select(*key), list(key), "left_anti")
    return test.unionByName(cal).unionByName(train.withColumn("part", F.lit("train"))).drop("fold", "role")

"""Exact interpolated quantiles without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.functions.exprs import so_far
from causalbars.plans.staging import stage

_SPLITS = 64


def cut_points(n: int = _SPLITS) -> list[float]:
    """Levels that cut a distribution into ``n`` slices of about equal size."""
    return [i / n for i in range(1, n)]


def slice_of(value: Column, cuts: Column | str) -> Column:
    """Number of the slice a value falls into; the order of slices is the order of values."""
    return F.size(F.filter(cuts, lambda c: c < value))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: dict[str, Column], keep_empty: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group: (keys, n, <levels>).

    A level is a column over ``n``, the number of non-null values of the group, so it
    may depend on the group's size.  The built-in exact ``percentile`` keeps all
    distinct values of a group in one task.  Here each group is cut at approximate
    quantiles, values are counted per slice, and only the slices that hold a
    wanted rank are sorted.  ``keep_empty`` keeps groups without any value, with nulls.
    """
    keys = list(keys)
    group = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    counted = stage(counted, "value-counts")  # read by the cuts, the counts and the picks
    groups = counted.groupBy(*group).agg(
        F.sum("_c").alias("n"), F.percentile_approx("_v", cut_points(), 2000).alias("_cuts")
    )
    groups = groups.withColumns({f"_rank_{name}": (F.col("n") - 1) * level for name, level in levels.items()})
    # Approximate cuts depend on the order in which partial sketches arrive: counts and picks must see the same ones.
    groups = stage(groups, "cuts")

    # Without keys the group table is one row and the slice table at most _SPLITS rows.
    small = (lambda t: t) if keys else F.broadcast
    sliced = counted.join(small(groups.select(*group, "_cuts")), group).withColumn(
        "_slice", slice_of(F.col("_v"), "_cuts")
    )
    in_group = Window.partitionBy(*group).orderBy("_slice")
    slices = (
        sliced.groupBy(*group, "_slice")
        .agg(F.sum("_c").alias("_cnt"))
        .withColumn("_end", F.sum("_cnt").over(so_far(in_group)))
        .withColumn("_start", F.col("_end") - F.col("_cnt"))
        .join(small(groups.drop("_cuts")), group)
    )
    wanted = F.lit(False)
    for name in levels:
        rank = F.col(f"_rank_{name}")
        wanted = wanted | ((F.col("_start") <= F.ceil(rank)) & (F.col("_end") > F.floor(rank)))
    slices = slices.where(wanted).drop("_cnt", "_end")

    in_slice = Window.partitionBy(*group, "_slice").orderBy("_v")
    ranked = (
        sliced.drop("_cuts")
        .join(small(slices), [*group, "_slice"])
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(so_far(in_slice)))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )

    picks = []
    for name in levels:
        rank = F.col(f"_rank_{name}")
        for side, at in (("a", F.floor(rank)), ("b", F.ceil(rank))):
            hit = (F.col("_lo") <= at) & (at < F.col("_hi"))
            picks.append(F.min(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_w_{name}"))
    found = ranked.groupBy(*group).agg(F.max("n").alias("n"), *picks)
    values = [
        (F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_w_{name}")).alias(name)
        for name in levels
    ]
    out = found.select(*keys, "n", *values)
    if keep_empty and keys:
        out = rows.select(*keys).distinct().join(out, keys, "left").fillna(0, ["n"])
    return out

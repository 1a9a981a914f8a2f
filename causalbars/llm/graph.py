"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalbars.plans.staging import stage


def _is_stars(links: DataFrame) -> bool:
    """Whether each node a has one b, which is no a itself."""
    ends = links.select(F.col("a").alias("u"), "b").unionByName(links.select(F.col("b").alias("u"), F.lit(None).cast(links.schema["b"].dataType).alias("b")))
    nodes = ends.groupBy("u").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count_if(F.col("b").isNull()).alias("below"))
    astray = (F.col("least") < F.col("most")) | (F.col("least").isNotNull() & (F.col("below") > 0))
    return not nodes.agg(F.max(astray)).first()[0]


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every node of stored ``links`` (a, b) that reaches a smaller one, root being the smallest, stored.

    Alternating large-star and small-star steps: each node's larger neighbours, then its smaller ones, are linked to
    the smallest node of its neighbourhood, until every component is a star, which is seen from the links themselves.  Steps grow with
    the logarithm of the longest path.  Minima are pre-aggregated before each shuffle; a hub with many links is an ordinary skewed join key.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large-star")
        if _is_stars(large):
            return large.select(F.col("a").alias("node"), F.col("b").alias("root"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.unionByName(least.select("a", F.col("m").alias("b"))), "small-star")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that has another one, root being the smallest node that it reaches."""
    found = stars(stage(links.distinct(), "links"))
    roots = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.unionByName(roots)

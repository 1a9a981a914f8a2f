"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: Iterable[Column]) -> DataFrame:
    """A table of literal structs, planned wholly inside the JVM."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Set result columns; an input column of the same name (in any case) is replaced."""
    taken = {name.lower() for name in columns}
    kept = [c for c in df.columns if c.lower() not in taken]
    return df.select(*[df[f"`{c}`"] for c in kept], *[c.alias(n) for n, c in columns.items()])


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    spaces = " \t\n\x0b\x0c\r"
    marked = F.translate(text, spaces, " " * len(spaces))
    return F.coalesce(F.size(F.filter(F.split(marked, " "), lambda w: w != "")), F.lit(0)).cast("long")

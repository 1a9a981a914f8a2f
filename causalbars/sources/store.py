"""Partitioned bar store: year / month directories, parquet or CSV."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Moment = str | dt.date | dt.datetime


class BarStore:
    """Bars in a shared folder, split by year and month of their timestamp."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        fmt: str = "parquet",
        schema: T.StructType | None = None,
        ts: str = "timestamp",
    ):
        if fmt not in ("parquet", "csv"):
            raise ValueError("fmt must be 'parquet' or 'csv'")
        if fmt == "csv" and schema is None:
            raise ValueError("a csv store needs the schema of its rows")
        self.spark, self.path, self.fmt, self.schema, self.ts = spark, path, fmt, schema, ts

    def write(self, df: DataFrame, partition_cols: Sequence[str] = ("year", "month"), mode: str = "append") -> None:
        """Add rows; an empty frame writes no data.

        The rebalance hint lets adaptive execution split a hot month over several
        tasks and join small ones, by their real sizes.  Rows are sorted inside a
        file, so that the footers' ranges let readers skip by ticker and time.
        """
        out = df
        if self.ts in df.columns:
            out = out.withColumn("year", F.date_format(self.ts, "yyyy")).withColumn(
                "month", F.date_format(self.ts, "MM")
            )
        inside = [c for c in ("ticker", self.ts) if c in df.columns]
        out = out.hint("rebalance", *partition_cols).sortWithinPartitions(*partition_cols, *inside)
        writer = out.write.mode(mode).partitionBy(*partition_cols)
        if self.fmt == "csv":
            writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        writer.format(self.fmt).save(self.path)

    def read(self) -> DataFrame:
        reader = self.spark.read
        if self.fmt == "csv":
            with_parts = T.StructType(
                [
                    *self.schema.fields,
                    T.StructField("year", T.StringType()),
                    T.StructField("month", T.StringType()),
                ]
            )
            reader = (
                reader.schema(with_parts)
                .option("header", True)
                .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
            )
        return reader.format(self.fmt).load(self.path)

    def read_range(
        self, start: Moment | None = None, end: Moment | None = None, tickers: Sequence[str] | None = None
    ) -> DataFrame:
        """Rows with ``start <= ts <= end`` for the given tickers (none = all).

        The time bounds also become bounds on year and month, so that Spark skips
        directories before it opens a file.
        """
        df = self.read()
        partitioned = {"year", "month"} <= set(df.columns)
        month_no = F.col("year").cast("int") * 100 + F.col("month").cast("int") if partitioned else None
        for bound, after in ((start, True), (end, False)):
            if bound is None:
                continue
            at = F.lit(bound).cast("timestamp")
            bound_no = F.year(at) * 100 + F.month(at)
            df = df.where(F.col(self.ts) >= at if after else F.col(self.ts) <= at)
            if partitioned:
                df = df.where(month_no >= bound_no if after else month_no <= bound_no)
        if tickers:
            df = df.where(F.col("ticker").isin(list(tickers)))
        return df.orderBy(self.ts, "ticker")


def union_slices(*slices: DataFrame) -> DataFrame:
    """All slices as one table; a column missing from a slice reads null."""
    out = slices[0]
    for part in slices[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

"""Cut lineage by writing a result that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one named in ``spark.checkpoint.dir``.

    Where the setting is absent, a session whose driver and executors are one machine
    (tests, notebooks) gets a temporary folder; a cluster gets an error, because
    no local folder is seen by all its machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
    return _LOCAL_DIRS[context.applicationId]


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), row_group_mb: int = 128) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Later steps then scan only the columns they use, and only the folders that they ask for of the columns ``partition_by``,
    Catalyst sees real sizes, and a lost executor costs a re-read instead of a recomputation.  A task that writes holds one
    row group, so wide rows written beside Python workers ask for smaller ones.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/causalbars/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", row_group_mb << 20).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])

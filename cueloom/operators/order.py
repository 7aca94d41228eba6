"""Row numbers at scale, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cueloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "event_id", start: int = 0) -> DataFrame:
    """Rows with consecutive numbers in the order given.

    The rows are range-partitioned and sorted once; each partition is numbered by itself, and the partitions' sizes
    (one row each) give the offsets, so that no task sees more than its range. Ties in the order get any of the numbers.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*keys)
    ranged = written(ranged, "ranged")  # the ranges are sampled anew by every job, so they are fixed first
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_offset")
    out = ranged.withColumn("_row", F.row_number().over(w)).join(F.broadcast(offsets), "_part")  # a row for each partition
    return out.select((F.col("_offset") + F.col("_row") - 1 + start).cast("long").alias(name), *(c for c in df.columns if c != name))

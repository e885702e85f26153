"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, on one machine only, in a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/facts-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df``, written once and counted, marked for broadcast if it proves small."""
    table = stored(df)
    return F.broadcast(table) if table.count() <= limit else table


def ranked(df: DataFrame, order: list[Column | str], name: str = "row_idx") -> DataFrame:
    """Add contiguous 64-bit numbers in a given order, without gathering rows in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    # as many rows as partitions, whatever the input
    counts = placed.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__count"))
    before = counts.select("__of", (F.sum("__count").over(Window.orderBy("__of")) - F.col("__count")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = placed.withColumn("__nth", inside).join(F.broadcast(before), F.col("__part") == F.col("__of"))
    return numbered.withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__of", "__before", "__nth")

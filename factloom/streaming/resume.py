"""Incremental scoring of prediction files as they arrive (an extension of the resumable run).

A file source feeds micro-batches; finished files are known by the stream's checkpoint, so a restart
continues where the last commit ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring

ROWS = "SubjectEntity string, Relation string, ObjectEntities array<string>"


def score_stream(spark: SparkSession, folder: str, gold: DataFrame, output: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Score every prediction file that appears in a folder and append the scores to another."""
    incoming = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).json(folder).select("*", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("path"))

    def score(batch: DataFrame, number: int) -> None:
        # of copies in a batch the one in the newest file counts, as far as files tell
        at = F.struct("changed", "path", F.monotonically_increasing_id())
        order = Window.partitionBy(*scoring.KEY).orderBy(at.desc())
        rows = batch.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*scoring.KEY, "ObjectEntities", F.lit(0).alias("row_idx"))
        known = gold.join(rows.select(*scoring.KEY), scoring.KEY, "left_semi")
        # a batch that is run again after a failure replaces its own folder
        scoring.score_pairs(known, rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return incoming.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, output: str) -> DataFrame:
    """One score for each key: that of the last batch that had it."""
    scores = spark.read.parquet(output)
    order = Window.partitionBy(*scoring.KEY).orderBy(F.col("batch").desc())
    return scores.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "batch")

"""Scoring in batches that a broken-off run resumes: new files of prepared S1 records are matched as they come.

The stream's checkpoint takes the place of a marker file for each chunk. Each batch overwrites its own partition, so a
batch that is run again after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def match_arrivals(spark: SparkSession, folder: str, schema: str, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, files_a_batch: int = 64) -> StreamingQuery:
    """Runs match over the Parquet files in folder that no earlier run has matched, and ends; results are under out/batch=N."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def one(batch: DataFrame, number: int) -> None:
        match(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

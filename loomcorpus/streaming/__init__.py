"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mixing import rolling_cache


def text_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New .txt files under a root as (path, body, modified)."""
    read = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return read.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("modified"))


def ingest(stream: DataFrame, cache: str, checkpoint: str, keep: int, key: str = "id", version: str = "version") -> StreamingQuery:
    """Keeps the newest ``keep`` records of each source in ``cache``: each micro-batch is merged with the
    cache's last generation and written as the next, so a batch that runs again gives the same."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            batch = spark.read.schema(batch.schema).parquet(f"{cache}/generation={batch_id - 1}").unionByName(batch)
        rolling_cache(batch, keep, key, version).write.mode("overwrite").parquet(f"{cache}/generation={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

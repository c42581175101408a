"""Past counters as a stream: views by user and three-hour window, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def windowed_views(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n) of the events table, read as a stream to its end; the counters keep their state by window."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "3 hours"), "event_type").agg(F.count("*").alias("n"))
    rows = counted.select(F.unix_millis("window.start").alias("window_start"), "event_type", "n")
    path = shared_dir(spark)
    # updates go to files, numbered by batch: of each window the last counts. State behind the watermark is dropped.
    write = lambda batch, k: batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{k}")
    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], "window_start long, event_type string, n long, batch long").write.parquet(f"{path}/rows/none")
    found = spark.read.schema("window_start long, event_type string, n long, batch long").option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return found.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))

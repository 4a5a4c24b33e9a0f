"""Frames as a stream: windows and sessions with watermarks, and the last state of a running aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.storage import shared_path


def frame_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 64) -> DataFrame:
    """The files of a folder with this name pattern as a stream; ts as TIMESTAMP, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, keys: list[str], value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by key in tumbling or sliding windows; rows later than `late` are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of rows of a key without a longer gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def final_state(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its last complete result.

    Each batch replaces one folder of the shared place, so a repeated batch changes nothing; no row passes the driver.
    """
    spark = stream.sparkSession
    at = shared_path(spark, name)
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/result"))
    run.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def closed_windows(stream: DataFrame, name: str) -> DataFrame:
    """Runs a windowed stream in append mode over all that is there: a window is written once, when the watermark passes its end.

    State is dropped with it, so memory is bounded by the open windows; those still open at the end aren't in the result.
    """
    spark = stream.sparkSession
    at = shared_path(spark, name)
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/result").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")

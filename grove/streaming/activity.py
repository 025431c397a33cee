"""Streaming forms of the activity folds: an extension, the batch forms are in operators.activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path


def toggle_counts(stream: DataFrame) -> DataFrame:
    """Toggles of each pair so far; a pair is adopted while the number is odd. State: one number a pair."""
    return stream.groupBy("tree", "user_id").agg(F.count("*").alias("n"))


def watering_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Litres a tree and window; a window is final, and its state dropped, once the watermark has passed it."""
    timed = stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("tree", F.window("at", width)).agg(F.sum("amount").alias("litres"), F.count("*").alias("n"))


def run_adopted(toggles: DataFrame, spark: SparkSession) -> DataFrame:
    """Feeds a stream of toggles to its end and returns the pairs that are adopted then."""
    path = shared_path(spark)

    def replace(batch: DataFrame, number: int) -> None:
        batch.filter("n % 2 = 1").select("tree", "user_id").write.mode("overwrite").parquet(f"{path}/table/{number}")
        written.append(number)

    written: list[int] = []
    query = toggle_counts(toggles).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    if not written:
        return toggles.sparkSession.createDataFrame([], toggles.select("tree", "user_id").schema)
    return spark.read.parquet(f"{path}/table/{max(written)}")


def run_windows(waterings: DataFrame, spark: SparkSession, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Feeds a stream of waterings to its end and returns the final windows."""
    path = shared_path(spark)
    flat = watering_windows(waterings, width, late).select("tree", F.col("window.start").alias("start"), "litres", "n")
    flat.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/table").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{path}/table")

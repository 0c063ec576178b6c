"""The audit log as a stream: windows, repeated deliveries, append tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def audit_stream(spark, path: str, files: str) -> DataFrame:
    """The audit log as a stream of Parquet files, with event time ``ts``."""
    schema = spark.read.parquet(f"{path}/{files}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)
    return rows.withColumn("ts", F.timestamp_seconds("created_at"))


def audit_windows(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """(window_start, access_tier, requests, hits, blocked): tumbling counts; late rows up to a day are taken."""
    return (
        rows.withWatermark("ts", "1 day")
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.coalesce("access_tier", F.lit("none")).alias("access_tier"))
        .agg(
            F.count(F.lit(1)).alias("requests"), F.count_if("cache_hit").alias("hits"), F.count_if("rbac_blocked").alias("blocked")
        )
        .select(F.col("w.start").alias("window_start"), "access_tier", "requests", "hits", "blocked")
    )


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs ``stream`` over what there is, into a table below ``folder``; gives the table."""
    spark = stream.sparkSession
    target = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def once_each(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """The stream without repeated deliveries of an id within ``delay`` of event time."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def append_history(stream: DataFrame, folder: str) -> DataFrame:
    """Appends a stream to a table partitioned by day, each input file once; gives the table."""
    spark = stream.sparkSession
    dated = stream.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    query = (
        dated.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/state").partitionBy("day").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/table")

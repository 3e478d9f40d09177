"""The audit log as a stream: an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("timestamp string, trace_id string, phase string, data string").json(folder).withColumn("at", F.to_timestamp("timestamp"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each trace; entries later than `late` are dropped, and state older than that is freed."""
    out = log.withWatermark("at", late).groupBy("trace_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("entries"), F.max("phase").alias("last_phase"))
    return out.select("trace_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "entries", "last_phase")


def phase_counts(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "phase").agg(F.count(F.lit(1)).alias("entries")).select(F.col("w.start").alias("started"), "phase", "entries")


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final; started again with its checkpoint, it goes on where it stopped."""
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()

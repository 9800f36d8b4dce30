"""Incremental ingest: new reading files, each processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_readings(spark: SparkSession, path: str, schema: str = "tx_id string, hh timestamp, kva double", pattern: str = "*.csv") -> DataFrame:
    """New CSV files below a folder. Times are zoned here, since a watermark needs that (a UTC session keeps them)."""
    return spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)


def half_hour_totals(readings: DataFrame, factor: float = 0.95, late: str = "2 hours") -> DataFrame:
    """Sums per site and half hour, emitted once the watermark has passed them."""
    d = readings.where(F.col("tx_id").isNotNull() & F.col("hh").isNotNull()).withColumn("p", F.col("kva") * factor)
    g = d.withWatermark("hh", late).groupBy(F.window("hh", "30 minutes"), "tx_id").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("active_power_kW"))
    return g.select("tx_id", F.col("window.start").alias("hh"), "active_power_kW")


def completeness(readings: DataFrame) -> DataFrame:
    """Running completeness per site (complete or update mode)."""
    g = readings.where(F.col("tx_id").isNotNull()).groupBy("tx_id").agg(F.count(F.lit(1)).alias("total_points"), F.count("kva").alias("non_nan_points"))
    return g.withColumn("fraction_non_nan", F.col("non_nan_points") / F.col("total_points"))


def ingest_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later call takes only what is new."""
    return df.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").start(out)

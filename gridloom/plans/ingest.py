"""Ingest: raw half-hour readings to filled, aggregated, ranked and located power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregate, clean, joins, timeseries


def half_hour_power(raw: DataFrame, *, key: str = "tx_id", ts: str = "hh", kva: str = "kva", factor: float = 0.95) -> DataFrame:
    """Clean, scale, fill forward per site, and sum per site and half hour."""
    d = clean.to_number(clean.require(raw, key, ts, kva), kva).na.drop(subset=[key, ts])
    d = clean.scale_power(d, factor, kva)
    d = timeseries.forward_fill(d, "active_power_kW", key, ts).withColumn(ts, timeseries.half_hour(F.col(ts)))
    return aggregate.sum_by(d, [key, ts], "active_power_kW")


def site_power_with_completeness(raw: DataFrame, *, key: str = "tx_id", ts: str = "hh", kva: str = "kva", factor: float = 0.95) -> DataFrame:
    """Half-hour power of each site and the share of its readings that are present."""
    return half_hour_power(raw, key=key, ts=ts, kva=kva, factor=factor).join(aggregate.completeness(raw, key, kva), key)


def locate(agg: DataFrame, geo: DataFrame, threshold: float = 0.6, key: str = "tx_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aggregate with coordinates, matches, unmatched names)."""
    named = clean.to_text(agg, key, "location_name")
    best = joins.best_match(named, geo, threshold)
    hits = joins.matched(best)
    return joins.attach_coordinates(named, hits), hits, joins.unmatched(best)


def to_model_table(agg: DataFrame, key: str = "tx_id", ts: str = "hh") -> DataFrame:
    """The bridge from ingest to the models: site, timestamp, power in MW."""
    return agg.select(F.col(key).cast("string").alias("location"), F.col(ts).alias("timestamp"), (F.col("active_power_kW") / 1000).alias("active_power_mw_clean"))

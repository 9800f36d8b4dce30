"""Small tables for people: lines to plot, file checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from gridloom.operators import aggregate, clean, joins, sampling, timeseries


def plot_lines(df: DataFrame, value: str, *, sites: int = 10, start: Column, days: int = 7, every: int = 1, key: str = "location", ts: str = "timestamp", seed: int = 42) -> DataFrame:
    """Every n-th point of a few sampled sites within [start, start + days)."""
    some = sampling.sample_keys(df, key, sites, seed)
    near = joins.trained_only(df.where(clean.half_open(ts, start, days)), some, key)
    return timeseries.every_nth(near.select(key, ts, value), every, key, ts)


def sanity(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """One row: size, sites, span, missing values and their share."""
    return aggregate.report(df, key, ts, value)

"""Merge: site power with gridded weather."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators import joins
from gridloom.sources import files


def combine(power: DataFrame, mapping: DataFrame, weather: DataFrame, step: float = 0.25) -> DataFrame:
    """Power beside the weather of its site's cell, on (location, timestamp)."""
    return joins.power_to_cells(power, mapping, weather, step)


def combine_files(spark, power_path: str, mapping_path: str, weather: DataFrame, out: str) -> None:
    """From files to one snappy Parquet table."""
    files.write_parquet(combine(files.read_power(spark, power_path), files.read_mapping(spark, mapping_path), weather), out)

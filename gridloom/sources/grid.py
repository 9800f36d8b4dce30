"""Gridded weather (time x lat x lon) as a long table, by a Python data source with a pluggable decoder."""

from __future__ import annotations

import glob
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a decoder returns: time (datetime64), lat and lon vectors, and arrays of shape (time, lat, lon) by variable.
Grid = tuple[np.ndarray, np.ndarray, np.ndarray, Mapping[str, np.ndarray]]


def decode_json(path: str) -> Grid:
    """{"time": [...], "latitude": [...], "longitude": [...], "variables": {name: nested lists}}"""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return np.array(d["time"], "datetime64[us]"), np.array(d["latitude"], float), np.array(d["longitude"], float), {k: np.array(v, float) for k, v in d["variables"].items()}


DECODERS: dict[str, Callable[[str], Grid]] = {"json": decode_json}


def list_grids(pattern: str) -> list[str]:
    """Matching files, sorted; none is an error."""
    if not (found := sorted(glob.glob(pattern))):
        raise FileNotFoundError(f"no grid file matches {pattern}")
    return found


class GridReader(DataSourceReader):
    def __init__(self, files: Sequence[str], decoder: str, variables: Sequence[str]):
        self.files, self.decoder, self.variables = list(files), decoder, list(variables)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """One batch per time step: the grid's cells, row by row of latitude."""
        time, lat, lon, values = DECODERS[self.decoder](partition.value)
        cells = len(lat) * len(lon)
        la, lo = pa.array(np.repeat(lat, len(lon))), pa.array(np.tile(lon, len(lat)))
        names = ["timestamp", "era5_lat", "era5_lon", *(f"weather_{v}" for v in self.variables)]
        for t, stamp in enumerate(time.astype("datetime64[us]")):
            x = [values[v][t].astype(float).ravel() if v in values else np.full(cells, np.nan) for v in self.variables]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, stamp)), la, lo, *(pa.array(c, from_pandas=True) for c in x)], names)


class GridSource(DataSource):
    """Options: path (glob), decoder, variables (comma-separated). A file is a partition; NaN is null."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        names = self.options["variables"].split(",")
        return ", ".join(["timestamp timestamp_ntz", "era5_lat double", "era5_lon double", *(f"weather_{v} double" for v in names)])

    def reader(self, schema) -> GridReader:
        return GridReader(list_grids(self.options["path"]), self.options.get("decoder", "json"), self.options["variables"].split(","))


def read_grids(spark: SparkSession, pattern: str, variables: Sequence[str], decoder: str = "json") -> DataFrame:
    """timestamp, era5_lat, era5_lon and weather_<variable> of all files; a variable that a file lacks is null."""
    spark.dataSource.register(GridSource)
    return spark.read.format("grid").option("path", pattern).option("decoder", decoder).option("variables", ",".join(variables)).load()


def explode_grid(df: DataFrame, variable: str, time: str = "time", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A row with coordinate arrays and a nested value array -> long rows (the same in expressions alone)."""
    d = df.select(time, lat, lon, F.posexplode(variable).alias("_t", "_a"))
    d = d.select(time, lat, lon, "_t", F.posexplode("_a").alias("_i", "_b")).select(time, lat, lon, "_t", "_i", F.posexplode("_b").alias("_j", "_v"))
    return d.select(F.col(time)[F.col("_t")].alias("timestamp"), F.col(lat)[F.col("_i")].alias("era5_lat"), F.col(lon)[F.col("_j")].alias("era5_lon"), F.col("_v").alias(f"weather_{variable}"))

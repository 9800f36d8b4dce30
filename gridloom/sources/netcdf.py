"""Gridded weather in classic NetCDF (versions 1, 2 and 5): a data source that reads time slabs by byte range."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources.grid import list_grids

# Fixed values of the format: type number -> big-endian numpy type, and the tags of the header's lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
_UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    attributes: dict
    dtype: str
    begin: int
    record: bool


@dataclass
class Header:
    """What stands before the data: dimension lengths (records included), variables, and the bytes from record to record."""

    lengths: dict[str, int] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    stride: int = 0


class _Short(Exception):
    """The header goes on beyond the bytes at hand."""


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.wide = raw, 0, False

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise _Short
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out

    def int4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def int8(self) -> int:
        return struct.unpack(">q", self.take(8))[0]

    def count(self) -> int:
        return self.int8() if self.wide else self.int4()

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def listed(self, tag: int) -> int:
        """Entries of a list that must carry ``tag``; an absent one has none."""
        found, n = self.int4(), self.count()
        if n and found != tag:
            raise ValueError(f"list {found} where {tag} was due")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTES)):
            name, kind, n = self.name(), self.int4(), self.count()
            dtype = np.dtype(TYPES[kind])
            raw = self.padded(n * dtype.itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out


def parse_header(raw: bytes, size: int) -> Header:
    """The header of a file of ``size`` bytes from its first bytes."""
    c = _Cursor(raw)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    c.wide = magic[3] == 5
    records = c.count()
    out = Header()
    dims = [(c.name(), c.count()) for _ in range(c.listed(DIMENSIONS))]
    c.attributes()
    entries = []
    for _ in range(c.listed(VARIABLES)):
        name = c.name()
        ids = [c.count() for _ in range(c.count())]
        attributes, kind = c.attributes(), c.int4()
        c.count()  # the stated size, which large variables do not have
        begin = c.int4() if magic[3] == 1 else c.int8()
        entries.append((name, Variable(tuple(dims[i][0] for i in ids), attributes, TYPES[kind], begin, bool(ids) and dims[ids[0]][1] == 0)))
    out.lengths, out.variables = dict(dims), dict(entries)
    inner = [(v, int(np.prod([out.lengths[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.dtype).itemsize) for v in out.variables.values() if v.record]
    out.stride = inner[0][1] if len(inner) == 1 else sum(n + -n % 4 for _, n in inner)  # a single one is not padded
    if records < 0 and inner:  # written as a stream: as many as the file holds
        records = (size - min(v.begin for v, _ in inner)) // max(out.stride, 1)
    out.lengths.update({d: records for d, n in dims if n == 0})
    return out


class File:
    """Byte ranges of one file, local or of any store that pyarrow knows by its address."""

    def __init__(self, path: str):
        store, at = pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)
        self.handle = store.open_input_file(at)
        n = 1 << 16
        while True:
            raw = self.handle.read_at(min(n, self.handle.size()), 0)
            try:
                self.header = parse_header(raw, self.handle.size())
                return
            except _Short:
                if n > self.handle.size():
                    raise ValueError(f"{path}: the header is cut off") from None
                n *= 4

    def read(self, name: str, first: int, end: int) -> np.ndarray:
        """Entries first .. end - 1 along a variable's first dimension, as stored."""
        v, h = self.header.variables[name], self.header
        shape = [h.lengths[d] for d in v.dims[1:]]
        one = int(np.prod(shape, dtype=np.int64)) * np.dtype(v.dtype).itemsize
        if v.record and h.stride != one:
            raw = b"".join(self.handle.read_at(one, v.begin + t * h.stride) for t in range(first, end))
        else:
            raw = self.handle.read_at(one * (end - first), v.begin + first * one)
        return np.frombuffer(raw, v.dtype).reshape(end - first, *shape)

    def values(self, name: str, first: int, end: int) -> np.ndarray:
        """The same as doubles: fill values are NaN, scale and offset applied."""
        a, raw = self.header.variables[name].attributes, self.read(name, first, end)
        x = raw.astype(float)
        for k in ("_FillValue", "missing_value"):
            for fill in a.get(k, ()) if not isinstance(a.get(k), str) else ():
                x[raw == fill] = np.nan
        return x * (a.get("scale_factor") or [1.0])[0] + (a.get("add_offset") or [0.0])[0]

    def whole(self, name: str) -> np.ndarray:
        return self.values(name, 0, self.header.lengths[self.header.variables[name].dims[0]])

    def times(self, name: str) -> np.ndarray:
        """The time coordinate as datetime64[us], from its units: a number of ... since ..."""
        m = re.match(r"\s*(second|minute|hour|day)s? since ([0-9]+-[0-9]+-[0-9]+)(?:[T ]+([0-9:.]+))?", str(self.header.variables[name].attributes.get("units", "")))
        if not m:
            raise ValueError("the time coordinate's units are not a number of seconds, minutes, hours or days since a date")
        date = "-".join(p.zfill(n) for p, n in zip(m[2].split("-"), (4, 2, 2), strict=True))
        origin = datetime.fromisoformat(f"{date}T{':'.join(p.zfill(2) for p in (m[3] or '0:0').split(':'))}")
        return np.datetime64(origin, "us") + np.rint(self.whole(name) * _UNITS[m[1]]).astype("timedelta64[us]")


@dataclass
class Slab(InputPartition):
    """Time steps first .. end - 1 of a file."""

    path: str
    first: int
    end: int


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.variables = list_grids(options["path"]), options["variables"].split(",")
        self.time, self.lat, self.lon = (options.get(k, d) for k, d in (("time", "time"), ("lat", "latitude"), ("lon", "longitude")))
        self.bytes, self.low, self.high = int(options.get("slabBytes", 1 << 26)), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the timestamp choose the slabs; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("timestamp",) and isinstance(getattr(f, "value", None), datetime):
                at = np.datetime64(f.value.replace(tzinfo=None), "us")
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = at if self.low is None else max(self.low, at)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = at if self.high is None else min(self.high, at)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Headers and time coordinates are all that is read here. Slabs are of about ``slabBytes`` of rows."""
        out: list[InputPartition] = []
        for path in self.files:
            f = File(path)
            t = f.times(self.time)
            wanted = np.ones(len(t), bool)
            if self.low is not None:
                wanted &= t >= self.low
            if self.high is not None:
                wanted &= t <= self.high
            at = np.flatnonzero(wanted)
            if len(at):
                cells = f.header.lengths[f.header.variables[self.lat].dims[0]] * f.header.lengths[f.header.variables[self.lon].dims[0]]
                steps = max(1, self.bytes // max(1, cells * 8 * (3 + len(self.variables))))
                out += [Slab(path, k, min(k + steps, int(at[-1]) + 1)) for k in range(int(at[0]), int(at[-1]) + 1, steps)]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        """One batch per time step: the grid's cells, row by row of latitude."""
        f = File(partition.path)
        known = [v for v in self.variables if v in f.header.variables]
        for v in known:
            if f.header.variables[v].dims != (self.time, self.lat, self.lon):
                raise ValueError(f"{partition.path}: {v} is not of ({self.time}, {self.lat}, {self.lon})")
        lat, lon = f.whole(self.lat), f.whole(self.lon)
        la, lo = pa.array(np.repeat(lat, len(lon))), pa.array(np.tile(lon, len(lat)))
        names = ["timestamp", "era5_lat", "era5_lon", *(f"weather_{v}" for v in self.variables)]
        times = f.times(self.time)
        none = pa.nulls(len(la), pa.float64())
        for t in range(partition.first, partition.end):
            x = [pa.array(f.values(v, t, t + 1).ravel(), from_pandas=True) if v in known else none for v in self.variables]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(la), times[t])), la, lo, *x], names)


class NetcdfSource(DataSource):
    """Options: path (glob), variables (comma-separated), time, lat, lon (their names), slabBytes."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        names = self.options["variables"].split(",")
        return ", ".join(["timestamp timestamp_ntz", "era5_lat double", "era5_lon double", *(f"`weather_{v}` double" for v in names)])

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options)


def read_netcdf(spark: SparkSession, pattern: str, variables: Sequence[str], **options: object) -> DataFrame:
    """timestamp, era5_lat, era5_lon and weather_<variable> of all files; a variable that a file lacks is null, as are fill values.

    A task reads a slab of time steps, and of it the bytes of the wanted variables only; a range of timestamps asked for
    above opens no other slab. Files of other formats (version 4 is HDF5) are an error.
    """
    spark.dataSource.register(NetcdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("netcdf3").option("path", pattern).option("variables", ",".join(variables))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()

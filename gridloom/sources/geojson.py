"""GeoJSON features as rows with a name and a centroid."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.tables import settled


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: pos (order in the file), properties (map), kind, coordinates (JSON text).

    A file is one collection: Spark's reader stops at the end of a file's first one.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.posexplode("features").alias("pos", "f")).select("pos", "f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


#: What a scan of JSON must see: escapes, string borders, and what opens and closes.
_TOKEN = re.compile(rb'\\.|["{}\[\]]', re.S)


def _open(path: str):
    store, at = pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _escaped(f, at: int) -> bool:
    """Whether the byte at ``at`` stands behind an odd number of backslashes, so that it begins nothing."""
    n, block = 0, 64
    while at - n > 0:
        size = min(block, at - n)
        tail = f.read_at(size, at - n - size)
        run = len(tail) - len(tail.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n % 2 == 1


def _step(token: bytes, inside: bool, depth: int) -> tuple[bool, int]:
    """Within a string or not, and how deep, after a token."""
    if token == b'"':
        return not inside, depth
    if inside or token[:1] == b"\\":
        return inside, depth
    return inside, depth + (1 if token in b"{[" else -1)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each byte range, what it does to a scan that enters it outside a string, and inside one."""
    for b in batches:
        for r in b.to_pylist():
            with _open(r["path"]) as f:
                skip = int(_escaped(f, r["first"]))
                data = f.read_at(r["end"] - r["first"] - skip, r["first"] + skip)
            out, states = dict(r), [(False, 0), (True, 0)]
            for m in _TOKEN.finditer(data):
                states = [_step(m[0], *s) for s in states]
            for k, (inside, depth) in enumerate(states):
                out |= {f"inside{k}": inside, f"depth{k}": depth}
            yield pa.RecordBatch.from_pylist([out])


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features that begin in each byte range, in order; the last one is read to its end."""
    for b in batches:
        for r in b.to_pylist():
            with _open(r["path"]) as f:
                at = r["first"] + int(_escaped(f, r["first"]))
                inside, depth, begun, held, k, rows = r["inside"], r["depth"], None, b"", 0, []
                while at < r["end"] or begun is not None:
                    data = f.read_at(1 << 20 if at >= r["end"] else min(1 << 20, r["end"] - at), at)
                    if not data:
                        break
                    if data.endswith(b"\\"):
                        data += f.read_at(1, at + len(data))  # an escape stays whole
                    done = False
                    for m in _TOKEN.finditer(data):
                        if m[0] == b"{" and not inside and depth == 2 and begun is None:
                            if at + m.start() >= r["end"]:
                                done = True
                                break
                            begun, held = m.start(), b""
                        inside, depth = _step(m[0], inside, depth)
                        if begun is not None and m[0] == b"}" and not inside and depth == 2:
                            x = json.loads(held + data[begun : m.end()])
                            begun, held = None, b""
                            if x.get("type") == "Feature":
                                g = x.get("geometry") or {}
                                props = [(n, _text(v)) for n, v in (x.get("properties") or {}).items()]
                                rows.append({"path": r["path"], "part": r["part"], "k": k, "properties": props, "kind": g.get("type"), "coordinates": _text(g.get("coordinates"))})
                                k += 1
                    if begun is not None:
                        held, begun = held + data[begun:], 0
                    at += len(data)
                    if done:
                        break
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, _FEATURE)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FEATURE)


_FEATURE = pa.schema([("path", pa.string()), ("part", pa.int64()), ("k", pa.int64()), ("properties", pa.map_(pa.string(), pa.string())), ("kind", pa.string()), ("coordinates", pa.string())])


def read_large_features(spark: SparkSession, paths: Sequence[str], split: int = 64 << 20) -> DataFrame:
    """``read_features`` for collections of any size: files are cut into byte ranges of ``split``, and a task reads the features that
    begin in its own, so no task holds a file.

    Where a range begins, it is not known whether that is within a string, or how deep. So a first pass scans every range for
    both cases; what each does to a scan is three values, which chained from range to range (on the driver, a row per
    range) give every range's true start. The second pass parses the features: objects two levels down of type Feature.
    ``pos`` numbers them over all files, in the order of ``paths``. Local paths and addresses that pyarrow's file systems know.
    """
    ranges = []
    for p in paths:
        with _open(p) as f:
            ranges += [(p, a, min(a + split, f.size())) for a in range(0, f.size(), split)]
    if not ranges:
        return spark.createDataFrame([], "pos long, properties map<string,string>, kind string, coordinates string")
    schema = "path string, part long, first long, end long"
    table = spark.createDataFrame([(p, k, a, b) for k, (p, a, b) in enumerate(ranges)], schema).repartition(len(ranges), "part")
    seen = table.mapInArrow(_changes, f"{schema}, inside0 boolean, depth0 long, inside1 boolean, depth1 long").orderBy("part").collect()
    starts, state, last = [], (False, 0), None
    for r in seen:
        state = (False, 0) if r["path"] != last or r["first"] == 0 else state
        starts.append((r["path"], r["part"], r["first"], r["end"], *state))
        state, last = (r[f"inside{int(state[0])}"], state[1] + r[f"depth{int(state[0])}"]), r["path"]
    known = spark.createDataFrame(starts, f"{schema}, inside boolean, depth long").repartition(len(ranges), "part")
    rows = settled(known.mapInArrow(_features, "path string, part long, k long, properties map<string,string>, kind string, coordinates string"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row per range
    return rows.join(F.broadcast(base), "part").select((F.col("_b") + F.col("k")).alias("pos"), "properties", "kind", "coordinates")


def ring_moments(ring: Column) -> Column:
    """struct(a, x, y): signed area and first moments of a closed ring of [lon, lat], by the shoelace formula."""
    step = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: F.struct((p[0] * q[1] - q[0] * p[1]).alias("c"), (p[0] + q[0]).alias("x"), (p[1] + q[1]).alias("y")),
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(step, zero, lambda s, t: F.struct((s["a"] + t["c"] / 2).alias("a"), (s["x"] + t["x"] * t["c"] / 6).alias("x"), (s["y"] + t["y"] * t["c"] / 6).alias("y")))


def centroids(features: DataFrame, name_columns: Sequence[str]) -> DataFrame:
    """pos, geo_name, longitude, latitude.

    The name is the first of ``name_columns`` that any feature has, else the position. Points are their own centroid;
    polygons and multipolygons weigh rings by area (holes count against), in degrees.
    """
    have = {r["k"] for r in features.select(F.explode(F.map_keys("properties")).alias("k")).where(F.col("k").isin(list(name_columns))).distinct().collect()}
    name = next((c for c in name_columns if c in have), None)
    parse = lambda t: F.from_json("coordinates", t)
    polygon = F.when(F.col("kind") == "Polygon", F.array(parse("array<array<array<double>>>"))).when(F.col("kind") == "MultiPolygon", parse("array<array<array<array<double>>>>"))
    # The first ring of a polygon bounds it; any other one is a hole.
    signed = lambda m, i: F.struct(*[(F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.signum(m["a"]) * m[k]).alias(k) for k in ("a", "x", "y")])
    rings = F.flatten(F.transform(polygon, lambda p: F.transform(p, lambda r, i: F.struct(ring_moments(r).alias("m"), i.alias("i")))))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(F.transform(rings, lambda r: signed(r["m"], r["i"])), zero, lambda s, t: F.struct((s["a"] + t["a"]).alias("a"), (s["x"] + t["x"]).alias("x"), (s["y"] + t["y"]).alias("y")))
    d = features.withColumns({"_m": total, "_p": F.when(F.col("kind") == "Point", parse("array<double>"))})
    return d.select(
        "pos",
        (F.col("properties")[name] if name else F.col("pos").cast("string")).alias("geo_name"),
        F.coalesce(F.col("_p")[0], F.try_divide("_m.x", "_m.a")).alias("longitude"),
        F.coalesce(F.col("_p")[1], F.try_divide("_m.y", "_m.a")).alias("latitude"),
    )


def numbered(df: DataFrame, order: str = "geo_name") -> DataFrame:
    """Row order for tables that have none (small ones: a window over all rows)."""
    return df.withColumn("pos", (F.row_number().over(W.orderBy(order)) - 1).cast("long"))

"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import forget, written_at


#: Links that one task contracts in memory before the rounds.
CHUNK = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task -> a star per component that they form; union-find by least node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    stars = [(x, r) for x in up if (r := root(x)) != x]
    a, b = zip(*stars, strict=True) if stars else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, root) for every linked node; root is the least node of its component.

    Large-star links every larger neighbour to the least one around a node, small-star every smaller one; both
    keep components, and the table settles at one star per component after about log(n) rounds. First, tasks of CHUNK
    links each (bounded memory, as many tasks as that takes) replace their links by the stars that these form, so that
    the many links of a dense group do not go through the rounds. Every round is a
    pre-aggregated minimum and a join that adaptive execution may split at a hot node; tables are written to the
    shared folder between rounds and dropped as they are replaced. An empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, old = written_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if n := now.count():
        now, path = written_at(now.repartition(math.ceil(n / CHUNK)).mapInArrow(_contract, "a long, b long").distinct(), "links")
        forget(spark, old)
        old = path
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(first.select("a", F.col("m").alias("b"))).distinct()
        new, path = written_at(small, "links")
        was = state
        state = _state(new)
        forget(spark, old)
        now, old = new, path
        if state == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

"""Tables computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTLED: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named and sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return (named or _OWN[sc.applicationId]).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as Parquet and read back, which outlives lost executors and tells the planner its size.
    ``release`` removes what a session has written so."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}-settled"
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``small`` of ``settled``, counted while it is written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return F.broadcast(out) if seen.get["n"] <= rows else out.hint("merge")


class Relay:
    """A table that goes through rounds: each round's is settled and measured in one job, then the one before is deleted. So it
    takes the room of two rounds, and plans do not grow."""

    def __init__(self) -> None:
        self._path: str | None = None

    def next(self, df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
        """``df`` (made of the last round's table) settled, and aggregates over its rows by name."""
        seen, written = Observation(), _SETTLED.setdefault(df.sparkSession.sparkContext.applicationId, [])
        out = settled(df.observe(seen, *measures) if measures else df)
        if self._path in written:
            written.remove(self._path)
            _delete(df.sparkSession, self._path)
        self._path = written[-1]
        return out, seen.get if measures else {}


def release(spark: SparkSession) -> None:
    """Delete the tables that ``settled`` has written in this session; results read from them are void after."""
    for path in _SETTLED.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Hint for a join with a narrow settled table: broadcast if a count shows ``rows`` at most, else sort-merge, whose skewed
    partitions adaptive execution splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")

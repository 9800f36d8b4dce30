"""Shared pieces of the corpus operators: text units, tables written to the shared folder, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The one definition of a word boundary for all operators: ASCII space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds at least 1/HOT_SHARE of the rows, or HOT_ROWS of them: HOT_SHARE keys at most, or one for
#: every HOT_ROWS rows of the table (100,000 in 10**11 rows).
HOT_SHARE, HOT_ROWS = 1000, 1_000_000


def text_of(name: str = "text") -> Column:
    """The whole text, null as the empty string."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to write, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own (local runs only)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.gettempdir()}/gridloom-checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_WRITTEN: dict[str, list[str]] = {}


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, known to ``release``."""
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}-{label}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written``, and where the copy lies."""
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The copy outlives lost executors. ``release`` removes what a session has written.
    """
    return written_at(df, label)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete one written table (any Hadoop file system)."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete the tables that this session's operators have written; results read from them are void after."""
    for p in written_so_far(spark):
        if p not in set(keep):
            forget(spark, p)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver's garbage collection finds it unused, which a large heap puts off while disks
    fill. To be called between steps whose results are written."""
    spark.sparkContext._jvm.System.gc()


def written_so_far(spark: SparkSession) -> list[str]:
    """Paths of the tables written and not released yet, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Hints for a join with a written table of numbers and short keys: broadcast if a count shows ``rows`` at most (tens of
    MB), else sort-merge, whose partitions adaptive execution may split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def attach(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join ``rows`` to one class row per key, safe for a key that holds a third of all rows.

    Hot classes (see HOT_SHARE) are few whatever the data, and are broadcast; all other keys have HOT_ROWS rows at
    most and are joined by an ordinary shuffle.
    """
    bar = max(min(total // HOT_SHARE, HOT_ROWS), 1)
    extra = [c for c in classes.columns if c != key]
    hot = classes.where(F.col(size) >= bar).where(F.col(size) > 1)
    cold = classes.where((F.col(size) < bar) | (F.col(size) <= 1))
    near = rows.join(F.broadcast(hot.withColumn("_gl_hot", F.lit(True))), key, "left")
    done = near.where(F.col("_gl_hot")).select(*rows.columns, *extra)
    rest = near.where(F.col("_gl_hot").isNull()).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *extra)
    return done.unionByName(rest)


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add 1, 2, 3, ... in an order over the whole table that leaves no ties.

    Rows are dealt by ranges of the order, sorted where they lie, and written; a row's number is its place in its range
    and the rows of the ranges before, summed over one row per range. ``df`` should be written: sampling reads it too.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_gl_n", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumns({"_gl_p": F.shiftrightunsigned("_gl_n", 33), "_gl_n": F.col("_gl_n").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("n").over(W.orderBy("_gl_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_gl_p").agg(F.count(F.lit(1)).alias("n")).select("_gl_p", before.alias("_gl_b"))
    return placed.join(F.broadcast(starts), "_gl_p").withColumn(out, (F.col("_gl_b") + F.col("_gl_n") + 1).cast("long")).drop("_gl_p", "_gl_n", "_gl_b")

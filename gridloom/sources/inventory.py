"""What lies in a folder: counts, sizes, data files, checkpoints."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings that count as data.
DATA_ENDINGS = ("csv", "xlsx", "xls", "parquet", "feather", "h5", "nc")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, relative, size, modified, extension, top) of every file below a driver-visible folder."""
    root, rows = Path(folder), []
    for d, _, names in os.walk(root):
        for n in names:
            p = Path(d) / n
            s = p.stat()
            rows.append((str(p), str(p.relative_to(root)), s.st_size, s.st_mtime))
    df = spark.createDataFrame(rows, "path string, relative string, size long, modified double")
    ext = F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1))
    top = F.when(F.contains("relative", F.lit("/")), F.split("relative", "/")[0])
    return df.withColumns({"extension": ext, "top": top})


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.sum("size").alias("total_size"))


def by_top_folder(files: DataFrame) -> DataFrame:
    """Files per top-level folder, most first."""
    return files.where(F.col("top").isNotNull()).groupBy("top").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "top")


def data_files(files: DataFrame, endings: Sequence[str] = DATA_ENDINGS) -> DataFrame:
    """Data files by their path below the folder, sorted."""
    return files.where(F.col("extension").isin(list(endings))).select(F.col("relative").alias("path")).orderBy("path")


def newest_checkpoint(files: DataFrame) -> str | None:
    """In the highest version_N: last.ckpt if there, else the newest file."""
    v = F.regexp_extract("relative", r"(?:^|/)version_([0-9]+)/", 1)
    d = files.where(F.col("extension") == "ckpt").withColumn("v", v.try_cast("int")).where("v IS NOT NULL")
    best = d.agg(F.max_by("path", F.struct("v", F.endswith("relative", F.lit("/last.ckpt")), "modified")).alias("p")).first()
    return best["p"] if best else None


def exists(path: str) -> bool:
    return Path(path).is_file()


def sizes(*paths: str) -> dict[str, int | None]:
    """Bytes of each file, None if it is not there."""
    return {p: os.path.getsize(p) if os.path.isfile(p) else None for p in paths}

"""Random choices that a rerun repeats: every one is keyed by a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, *columns: str) -> Column:
    """MD5 of seed and values: any engine can repeat the choice."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def hash_number(seed: int, *columns: str | Column) -> Column:
    """A number below 2**32 from the first eight hex digits of that hash."""
    values = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *values)), 1, 8), 16, 10).cast("long")


def sample_keys(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k distinct keys without replacement (top-k by hash, key as tie-break)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(hash_order(seed, key), key).limit(k)


def sample_rows(df: DataFrame, n: int, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows at most."""
    return df.orderBy(hash_order(seed, *columns), *columns).limit(n)


def draw_from_pool(keys: DataFrame, pool: DataFrame, draws: int, key: str, value: str, order: str, seed: int = 42, out: str = "value") -> DataFrame:
    """``draws`` values per key with replacement from the key's pool: (key, draw, value)."""
    pools = pool.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_p"))
    d = keys.join(pools, key).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    at = F.pmod(hash_number(seed, key, "draw"), F.size("_p")).cast("int")
    return d.withColumn(out, F.get("_p", at)[value]).drop("_p")


def candidates(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Empirical conditional sampler: k historical rows at most per key combination, by hash. Rows are real, so each
    stays within what was observed. A rank with a limit, which Spark applies in every task before the shuffle, so a group
    of any size costs k rows per task."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(hash_order(seed, *order), *order))
    return df.withColumn("candidate", place - 1).where(F.col("candidate") < k).select("candidate", *df.columns)

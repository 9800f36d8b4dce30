"""Two-pass external shuffle into shards: seeded scatter to memory-sized buckets, then Fisher-Yates in each bucket."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import small, text_of, without, written

#: Partitions of the scatter at most, and buckets whose starts (a few numbers each) are broadcast.
MOST_PARTITIONS, SMALL_BUCKETS = 1 << 15, 100_000
OUT = ("size", "law", "shard", "slot", "grown_shard")


def shard_of(key: Column, n: int, seed: int) -> Column:
    """Rendezvous hashing: the shard in 0..n-1 with the largest seeded hash of (key, shard).

    With one more shard a row moves only if the new shard's hash is the largest, so rows move only into it.
    """
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.lit(k).alias("k")) for k in range(n)])["k"]


def shuffle_into_shards(
    docs: DataFrame,
    *,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    bucket_bytes: int = 4 << 20,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Rows in shards: id, size, law, shard, slot, grown_shard and the text (plus ``carry``).

    The law is ``key``: shard and grown_shard (with one shard more) follow from the id and the number of shards alone.
    Pass one scatters rows by seeded hashes of id and text into buckets of about ``bucket_bytes`` within each shard, so
    copies of one text under different ids spread evenly; the number of buckets comes from the measured total. Rows that
    repeat id and text are measured too: where they are more than a bucket together, they are salted over all buckets of
    their shard. Pass two gathers each bucket (bounded by design), puts it into a fixed order and applies Fisher-Yates
    (Spark's ``shuffle``, one seed per partition over buckets in order), so a rerun with the same splits and partition
    count repeats it.
    Slots run from 0 without a gap in each shard, bucket after bucket.

    size is the UTF-8 bytes of the text plus 1 (a null text has none and stays null); a text of any length is one row.
    Null ids form one key. Input columns named like an output column are replaced. An empty table gives an empty one.
    """
    docs = without(docs, *[c for c in OUT if c.lower() not in (id_col.lower(), text_col.lower())])
    carry = [c for c in (carry or []) if c in docs.columns and c not in (id_col, text_col)]
    row = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in carry])
    row = row.withColumn("size", (F.octet_length(text_of(text_col)) + 1).cast("long"))
    key = F.col(f"`{id_col}`")
    row = row.withColumn("_gl_rank", F.xxhash64(F.lit(seed + 1), key, F.col(f"`{text_col}`")))
    alike = row.groupBy("_gl_rank").agg(F.sum("size").alias("b"))
    total, most = alike.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    parts = max(1, math.ceil(total / shards / bucket_bytes))

    row = row.withColumns({"shard": shard_of(key, shards, seed), "grown_shard": shard_of(key, shards + 1, seed)})
    place = F.col("_gl_rank")
    if most > bucket_bytes:  # fewer such ranks than buckets
        row = row.withColumn("_gl_salt", F.monotonically_increasing_id())
        heavy = written(alike.where(F.col("b") > bucket_bytes).select("_gl_rank", F.lit(True).alias("_gl_heavy")), "heavy")
        row = row.join(small(heavy), "_gl_rank", "left")
        place = F.when(F.col("_gl_heavy"), F.xxhash64("_gl_rank", "_gl_salt")).otherwise(place)
    row = row.withColumn("_gl_bucket", F.pmod(place, F.lit(parts)).cast("int"))

    # Pass one: the scatter, a partition for each bucket (several beyond MOST_PARTITIONS). The count is explicit, so
    # reruns see the same partitions.
    width = max(1, min(shards * parts, MOST_PARTITIONS))
    scattered = row.withColumn("_gl_part", ((F.col("shard") * parts + F.col("_gl_bucket")) % width).cast("int")).repartitionById(width, "_gl_part")
    fields = ["_gl_rank", id_col, "size", "grown_shard", text_col, *carry]
    gathered = scattered.groupBy("_gl_part", "shard", "_gl_bucket").agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in fields[:5]], F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("_gl_more")))).alias("_gl_rows"))
    # Pass two: Fisher-Yates within the bucket.
    shuffled = gathered.sortWithinPartitions("shard", "_gl_bucket").withColumn("_gl_rows", F.shuffle("_gl_rows", F.lit(seed)))
    flat = shuffled.select("shard", "_gl_bucket", F.posexplode("_gl_rows").alias("_gl_pos", "_gl_row"))
    shards_table = written(
        flat.select("shard", "_gl_bucket", "_gl_pos", *[F.col(f"_gl_row.`{c}`").alias(c) for c in fields[1:5]], *[F.col(f"_gl_row._gl_more.`{c}`").alias(c) for c in carry]),
        "shards",
    )
    # One row per bucket (total / bucket_bytes of them): where each starts in its shard.
    starts = shards_table.groupBy("shard", "_gl_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("_gl_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("shard", "_gl_bucket", before.alias("_gl_start"))
    if shards * parts <= SMALL_BUCKETS:  # their number is known, and the texts need not move again
        starts = F.broadcast(starts)
    return shards_table.join(starts, ["shard", "_gl_bucket"]).select(
        F.col(f"`{id_col}`"), "size", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("_gl_start") + F.col("_gl_pos")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in carry],
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, each ordered by slot across its files; any Hadoop file system."""
    out = rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").partitionBy("shard").parquet(path)

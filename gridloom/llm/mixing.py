"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, a cut at the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import small, text_of, without, word_count, words, written

OUT = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source -> the same with ``target`` (double).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops
    at ``cap`` times its source's size and the excess goes to the others by weight until none is above: in the order
    of cap / weight the capped sources are a prefix, so the final level follows from running sums. The only windows
    over everything run on this table of one row per source.
    """
    n = len(weights)
    at = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(at) - 1, F.lit(n)).cast("int") + 1))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "k": F.row_number().over(up),
            "below": F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "w_left": F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)),
            "all": F.sum("source_size").over(W.partitionBy()),
        }
    )
    s = s.withColumn("level", (F.lit(float(share)) * F.col("all") - F.col("below")) / F.col("w_left"))
    s = s.withColumn("free", F.col("ratio") > F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct("k", "level"))).over(W.partitionBy())["level"]
    return s.withColumn("final", final).select("source", "source_size", F.when(F.col("free"), F.col("final") * F.col("w")).otherwise(F.col("most")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    seed: int = 7,
    **share: object,
) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes of the row, repeats counted) to every row.

    Each row gets a hash-random key (MD5 of seed, id and size) that orders its source. The key's first three hex digits
    cut every source into 4096 ranges of near equal row counts; prefix sums of the ranges' sizes name the one in which
    the source's budget (the rounded target) ends, its next three digits cut that one again, input
    partitions cut what shares a key, and a window over the few rows left finds the row at the cut. Whole passes over the source come first, then
    rows up to that one, which is taken in part. So every source meets its budget exactly, no row exceeds the whole
    passes plus one, and rows are never moved: each compares its key with its source's cut, one row per source.

    ``size_col`` names a ready size (a negative or null one counts as 0); else the words of the whole text are counted, a
    null text having none. A null source is a source of its own, last in order. Rows with equal id and size share a
    key and go in row order, which must be the same each time the input is read (files are; write a shuffled input first). Input columns named like an output column are replaced. An empty table gives an empty one.
    """
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0)).cast("long") if size_col else word_count(text_of(text_col))
    docs = docs.withColumn("_gl_size", size)
    docs = without(docs, *[c for c in OUT if c.lower() not in (id_col.lower(), source_col.lower(), text_col.lower())])
    source, i = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(i.cast("string"), F.lit("")), F.col("_gl_size").cast("string")))
    docs = docs.withColumns({"_gl_src": F.coalesce(F.concat(F.lit("s"), source), F.lit("")), "_gl_at": F.struct(key.alias("key"), F.monotonically_increasing_id().alias("row"))})

    slim = written(docs.select("_gl_src", "_gl_at", "_gl_size"), "keys")
    before = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    digits = lambda k: F.substring("_gl_at.key", 1 + 3 * k, 3)

    ranges = written(slim.groupBy("_gl_src", digits(0).alias("r")).agg(F.sum("_gl_size").alias("n")), "ranges")
    sizes = ranges.groupBy("_gl_src").agg(F.sum("n").alias("source_size"))
    named = sizes.select(F.when(F.col("_gl_src") != "", F.substring("_gl_src", 2, 1 << 30)).alias("source"), "source_size")
    goals = targets(named, **share).withColumn("_gl_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("_gl_passes", passes).withColumn("_gl_rest", F.greatest(budget - F.col("_gl_passes") * F.col("source_size"), F.lit(0)))
    goals = written(goals, "goals")  # one row per source

    def cut(sums: DataFrame, rest: DataFrame) -> DataFrame:
        """(_gl_src, r, n) and (_gl_src, _gl_rest) -> the r at which each source's rest ends, and what is left of it there."""
        placed = sums.withColumn("start", before(["_gl_src"], "r")).join(small(rest), "_gl_src")
        return placed.where((F.col("start") < F.col("_gl_rest")) & (F.col("_gl_rest") <= F.col("start") + F.col("n"))).select("_gl_src", "r", (F.col("_gl_rest") - F.col("start")).alias("_gl_rest"))

    first = written(cut(ranges, goals.select("_gl_src", "_gl_rest")), "cut")
    inner = slim.withColumn("r", digits(0)).join(small(first.drop("_gl_rest")), ["_gl_src", "r"], "left_semi").drop("r")
    second = written(cut(inner.groupBy("_gl_src", digits(1).alias("r")).agg(F.sum("_gl_size").alias("n")), first.drop("r")), "cut")
    inner = inner.withColumn("r", digits(1)).join(small(second.drop("_gl_rest")), ["_gl_src", "r"], "left_semi")
    part = F.struct(F.col("_gl_at.key").alias("key"), F.shiftrightunsigned("_gl_at.row", 33).alias("part"))  # for rows that share a key
    third = written(cut(inner.groupBy("_gl_src", part.alias("r")).agg(F.sum("_gl_size").alias("n")), second.drop("r")), "cut")
    inner = inner.withColumn("r", part).join(small(third.drop("_gl_rest")), ["_gl_src", "r"], "left_semi")
    last = cut(inner.select("_gl_src", F.col("_gl_at").alias("r"), F.col("_gl_size").alias("n")), third.drop("r"))
    plan = written(goals.drop("_gl_rest").join(last.withColumnRenamed("r", "_gl_cut"), "_gl_src", "left"), "plan")

    placed = docs.join(small(plan), "_gl_src")
    rest = F.when(F.col("_gl_at") < F.col("_gl_cut"), F.col("_gl_size")).when(F.col("_gl_at") == F.col("_gl_cut"), F.col("_gl_rest")).otherwise(F.lit(0))
    taken = (F.col("_gl_passes") * F.col("_gl_size") + rest).cast("long")
    return placed.withColumns({"size": F.col("_gl_size"), "taken": taken}).drop("_gl_size", "_gl_src", "_gl_at", "_gl_passes", "_gl_cut", "_gl_rest")


def render(mixed: DataFrame, columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as it is taken, the last time cut to the words that are left.

    ``mixed`` comes from ``mix``. A copy that is taken whole keeps its text as it is; a cut one has its first words
    joined by a space. Rows of which nothing is taken are left out.
    """
    left = F.when(F.col("size") > 0, F.col("taken") - F.col("_gl_copy") * F.col("size"))
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0)).cast("int")
    out = mixed.where(F.col("taken") > 0).withColumn("_gl_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    cut: Column = F.array_join(F.slice(words(text_of(text_col)), F.lit(1), left.cast("int")), " ")
    out = out.withColumn("_gl_cut", F.when(left < F.col("size"), cut).otherwise(F.col(f"`{text_col}`")))
    return out.select(*[F.col("_gl_cut").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])

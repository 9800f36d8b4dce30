"""Exact duplicates by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import attach, small, text_of, without, written

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def _staged(docs: DataFrame, text: Column, digest: Callable[[Column], Column], extra: Sequence[Column]) -> DataFrame:
    """Written rows: _gl_row, _gl_key (equal for equal texts only) and ``extra``.

    Texts are hashed where they lie. Only those whose digest occurs twice or more are looked at again: an aggregation
    keyed by digest and text compares their bytes, and a digest of several texts is told apart by the text itself.
    """
    row = F.monotonically_increasing_id().alias("_gl_row")
    staged = written(docs.select(row, digest(text).alias("_gl_key"), *extra), "staged")
    count = F.count(F.lit(1)).alias("n")
    again = written(staged.groupBy("_gl_key").agg(count).where("n > 1").select("_gl_key"), "repeated")
    keyed = docs.select(digest(text).alias("_gl_key"), text.alias("_gl_text"))
    texts = keyed.join(small(again), "_gl_key", "left_semi").groupBy("_gl_key", "_gl_text").agg(count)
    clash = written(texts.groupBy("_gl_key").agg(count).where("n > 1").select("_gl_key"), "clash")
    if clash.isEmpty():
        return staged
    known = docs.withColumn("_gl_key", digest(text)).join(small(clash.withColumn("_gl_c", F.lit(True))), "_gl_key", "left")
    key = F.when(F.col("_gl_c"), F.concat("_gl_key", F.lit(":"), text)).otherwise(F.col("_gl_key"))
    return written(known.select(row, key.alias("_gl_key"), *extra), "staged")


def _best(staged: DataFrame, keep: str) -> DataFrame:
    """(_gl_key, _gl_n, _gl_keep, _gl_keep_row) of the groups with two rows or more; pre-aggregated before the shuffle."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    missing = F.col("_gl_id").isNull() if keep == "smallest" else F.col("_gl_id").isNotNull()
    groups = staged.groupBy("_gl_key").agg(F.count(F.lit(1)).alias("_gl_n"), best(F.struct(missing.alias("m"), "_gl_id", "_gl_row")).alias("b"))
    return written(groups.where("_gl_n > 1").select("_gl_key", "_gl_n", F.col("b._gl_id").alias("_gl_keep"), F.col("b._gl_row").alias("_gl_keep_row")), "classes")


def mark_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    carry: Sequence[str] = (),
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the columns named in ``carry``.

    Texts are equal when their UTF-8 bytes are. ``digest`` (128 bits) groups them, and the bytes are compared in every
    group (``_staged``); texts that occur once never move. Rows get their group by a join in which the (few) hot groups
    are broadcast.

    A null text counts as empty, so all of them are one group. Rows that repeat an id and its text are one group in
    which exactly one row is kept. A null id is never preferred to another; a group with null ids only keeps one row
    and has a null keep_id. Texts of any length are read whole. Input columns named like an output column are replaced.
    An empty table gives an empty one.
    """
    docs = without(docs, *[c for c in OUT if c.lower() not in (id_col.lower(), text_col.lower())])
    carry = [c for c in carry if c in docs.columns and c != id_col]
    text = text_of(text_col)
    staged = _staged(docs, text, digest, [F.col(f"`{id_col}`").alias("_gl_id"), F.sha2(text, 256).alias("text_sha256"), *[F.col(f"`{c}`") for c in carry]])
    joined = attach(staged, _best(staged, keep), "_gl_key", "_gl_n", staged.count())
    alone = F.col("_gl_n").isNull()
    return joined.select(
        F.col("_gl_id").alias(id_col),
        F.when(alone, F.col("_gl_id")).otherwise(F.col("_gl_keep")).alias("keep_id"),
        F.coalesce("_gl_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_gl_row") == F.col("_gl_keep_row"))).alias("kept"),
        "text_sha256",
        *[F.col(f"`{c}`") for c in carry],
    )


def drop_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """The rows that stay (see ``mark_duplicates``, whose edge cases hold), with the columns of ``docs``, whatever their names.

    Groups are found on digests and row numbers; the rows themselves meet only the list of those that go.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_gl_doc")
    staged = _staged(docs, text_of(text_col), digest, [F.col(f"`{id_col}`").alias("_gl_id"), whole])
    slim = staged.select("_gl_row", "_gl_key", "_gl_id")
    gone = attach(slim, _best(slim, keep), "_gl_key", "_gl_n", slim.count()).where(F.col("_gl_row") != F.col("_gl_keep_row"))
    return staged.join(small(written(gone.select("_gl_row"), "gone")), "_gl_row", "left_anti").select("_gl_doc.*")

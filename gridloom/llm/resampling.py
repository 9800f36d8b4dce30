"""Importance resampling towards a target: hashed n-gram features, counted over chunks that overlap."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, text_of, without, written
from gridloom.llm.lexical import terms_of

OUT = ("n_words", "n_features", "weight", "score", "rank")
#: Texts of more bytes are cut into chunks, and the chunks dealt over all tasks.
LONG = 65_536
#: Words whose features are made at a time in a task (about 40 MB).
AT_ONCE = 262_144
#: Words up to this length have a table of their own for carrying a checksum over them.
_SHORT = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """How zero bytes change a CRC-32 register, as four tables of 256 (the map is linear): for 0.._SHORT + 1 bytes, and
    for 1, 2, 4, ... bytes."""
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    one = one ^ one[0]  # the plain table: without the initial and final complement
    bits = np.arange(256, dtype=np.uint32)
    same = np.stack([bits << np.uint32(8 * k) for k in range(4)])
    steps = [same]
    for _ in range(_SHORT + 1):
        x = steps[-1]
        steps.append(one[x & 255] ^ (x >> np.uint32(8)))
    powers = [steps[1]]
    for _ in range(31):
        p = powers[-1]
        powers.append(p[0, p & 255] ^ p[1, p >> 8 & 255] ^ p[2, p >> 16 & 255] ^ p[3, p >> 24])
    return np.stack(steps), np.stack(powers)


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The register part of crc32(a + b) that stems from a: crc32(a) carried over len(b) = n bytes."""
    steps, powers = _tables()
    flat, at = steps.reshape(-1), np.minimum(n, _SHORT + 1) * 1024
    low, mid, high, top = (crc >> np.uint32(8 * k) & 255 for k in range(4))
    out = flat[at + low] ^ flat[at + 256 + mid] ^ flat[at + 512 + high] ^ flat[at + 768 + top]
    for i in np.flatnonzero(n > _SHORT + 1):
        x = int(crc[i])
        for j in range(int(n[i]).bit_length()):
            if int(n[i]) >> j & 1:
                p = powers[j]
                x = int(p[0, x & 255] ^ p[1, x >> 8 & 255] ^ p[2, x >> 16 & 255] ^ p[3, x >> 24])
        out[i] = x
    return out


def buckets(texts: Sequence[list[bytes]], own: Sequence[int | None], n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature: runs of 1 to ``n`` consecutive words of a text, joined by a space, that begin in its
    first ``own`` words (None: in any); bucket: crc32 modulo ``count``.

    The checksum of a run follows from those of its words, so no run is ever joined.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.full(len(words), zlib.crc32(b" "), np.uint32)
    spaced = carried(begin, length) ^ crc  # of " " + word
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - first[text]
    mine = place < np.array([len(t) if o is None else o for t, o in zip(texts, own, strict=True)], np.int64)[text]
    room = sizes[text] - place  # words from here to the end
    at, run, found = np.flatnonzero(mine), crc[mine], []
    for k in range(1, n + 1):
        found.append((text[at], run % np.uint32(count)))
        go = room[at] > k
        at, run = at[go], run[go]
        run = carried(run, length[at + k] + 1) ^ spaced[at + k]
    return np.concatenate([t for t, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64)


def overlapping(words: list[bytes], size: int, carry: int) -> Iterator[tuple[list[bytes], int]]:
    """Chunks of ``size`` words and the ``carry`` words after them; each owns the runs that begin in its own words."""
    for k in range(0, len(words), size):
        yield words[k : k + size + carry], min(size, len(words) - k)


def _is_long() -> Column:
    return F.octet_length("_gl_text") > LONG


def chunked(long: DataFrame, n: int, size: int) -> DataFrame:
    """(_gl_row, _gl_text) of long texts -> written (row, own, text): chunks of ``size`` words with n - 1 words of carry, dealt evenly
    over the tasks, so that no task has a long text to itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, (words, own) in enumerate(overlapping(terms_of(text.as_py()), size, n - 1)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([own], pa.int32()), pa.array([b" ".join(words)], pa.binary())], ["row", "k", "own", "text"])

    parts = long.select("_gl_row", "_gl_text").mapInArrow(cut, "row long, k long, own int, text binary")
    return written(parts.repartition("row", "k"), "chunks").drop("k")


def _grouped(rows: Iterator[tuple[int | None, int | None, bytes]]) -> Iterator[tuple[list[int | None], list[int | None], list[list[bytes]]]]:
    """Rows, owned words and words of about AT_ONCE words at a time."""
    at, own, texts, n = [], [], [], 0
    for r, o, t in rows:
        at.append(r)
        own.append(o)
        texts.append(terms_of(t))
        n += len(texts[-1])
        if n >= AT_ONCE:
            yield at, own, texts
            at, own, texts, n = [], [], [], 0
    if at:
        yield at, own, texts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, bytes]]:
    for b in batches:
        for r, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            yield r, o, t.as_py()


def count_features(texts: DataFrame, n: int, count: int) -> np.ndarray:
    """Features by bucket over all rows (row, own, text): each task counts its own, ``count`` rows at most, and Spark adds them up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, np.int64)
        for _, own, group in _grouped(_rows(batches)):
            total += np.bincount(buckets(group, own, n, count)[1], minlength=count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(count, np.int64)
    for r in texts.select("row", "own", "text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def sums_of(own: Sequence[int | None], texts: Sequence[list[bytes]], gain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and summed gains of each text (or chunk: what its own words begin)."""
    text, bucket = buckets(texts, own, n, len(gain))
    weight = np.rint(np.bincount(text, gain[bucket].astype(float), minlength=len(texts))).astype(np.int64)  # sums far below 2**53
    return np.array([len(t) if o is None else o for o, t in zip(own, texts, strict=True)], np.int64), np.bincount(text, minlength=len(texts)), weight


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares of the target's and the raw features, rounded down."""
    big_s, big_t, k = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k)))) for s, t in zip(map(float, raw), map(float, target), strict=True)], np.int64)


def noise(identity: Column, seed: int) -> Column:
    """A Gumbel variate (times 1000, rounded down) that SHA-256 of seed and id makes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: Sequence[str] | None = None,
    n: int = 3, count: int = 10_000, chunk: int = 4096, percent: int = 5, least_words: int = 20, seed: int = 42,
) -> DataFrame:
    """Add n_words, n_features, weight, score and rank to every row: a draw without replacement of ``percent`` per cent of the
    rows of at least ``least_words`` words, in proportion to how much more likely the target's features make them.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features all runs of 1 to ``n`` words,
    hashed into ``count`` buckets. Both tables' features are counted whole; a bucket's gain is the log ratio of its
    shares, a row's weight the sum of its features' gains, its score that plus Gumbel noise made of its id. The
    floor(percent * rows / 100) highest scores are drawn, ties to the smaller id; rank numbers them from 1, else null.

    Long texts (over LONG bytes) are cut at word boundaries into chunks of ``chunk`` words with n - 1 words of carry; a chunk
    owns the runs that begin in its own words, so every run counts once. Chunks are dealt over all tasks; counts are
    added up over chunks, weights by row. Two passes over the texts, one shuffle of the long ones, and a range
    sort of the rows' scores, in which no task sees all rows. The result, of the columns ``keep`` (default: all), is
    written once, and the long texts are.

    Null and empty texts have no words, weight 0, and are never drawn. Ids are integers; a null one counts as an empty one in
    the noise and comes last among ties. Rows that repeat an id or text are rows of their own, and of equal ones the first
    come first. An empty target gives every bucket the gain of a share of none. An empty table gives an empty one. Input
    columns named like an output column are replaced, others stay.
    """
    docs = without(docs, *[c for c in OUT if c not in (id_col.lower(), text_col.lower())])
    names = [c for c in docs.columns if keep is None or c in keep]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_gl_kept"), F.col(f"`{id_col}`").alias("_gl_id"), text_of(text_col).cast("binary").alias("_gl_text"))
    aims = target.select(text_of(target_text).cast("binary").alias("_gl_text"))

    def split(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Short rows where they lie, long ones written and numbered, and the long ones' chunks."""
        long = written(rows.where(_is_long()).withColumn("_gl_row", F.monotonically_increasing_id()), label)
        return rows.where(~_is_long()), long, chunked(long, n, chunk)

    def texts(short: DataFrame, chunks: DataFrame) -> DataFrame:
        return short.select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("own"), F.col("_gl_text").alias("text")).unionByName(chunks)

    short, long, chunks = split(docs, "long")
    near, _, near_chunks = split(aims, "target")
    gain = gains(count_features(texts(short, chunks), n, count), count_features(texts(near, near_chunks), n, count))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def whole(column: pd.Series) -> pd.DataFrame:
        parts = [sums_of(own, group, gain, n) for _, own, group in _grouped((None, None, t) for t in column)]
        return pd.DataFrame(dict(zip(OUT, map(np.concatenate, zip(*parts, strict=True)), strict=False)) if parts else {c: np.zeros(0, np.int64) for c in OUT[:3]})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, own, group in _grouped(_rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *map(pa.array, sums_of(own, group, gain, n))], ["row", *OUT[:3]])

    by_chunk = chunks.select("row", "own", "text").mapInArrow(weigh, "row long, n_words long, n_features long, weight long")
    by_row = by_chunk.groupBy(F.col("row").alias("_gl_row")).agg(*[F.sum(c).alias(c) for c in OUT[:3]])
    done = long.join(by_row, "_gl_row", "left").select("_gl_kept", "_gl_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in OUT[:3]])
    every = short.withColumn("_gl_w", whole("_gl_text")).select("_gl_kept", "_gl_id", "_gl_w.*").unionByName(done)
    every = every.withColumns({"score": (F.col("weight") + noise(F.col("_gl_id"), seed)).cast("long"), "_gl_row": F.monotonically_increasing_id()})
    every = written(every, "scores")
    fit = every.where(F.col("n_words") >= least_words)
    take = fit.count() * percent // 100
    drawn = numbered(fit.select("_gl_row", "_gl_id", "score"), [F.desc("score"), F.col("_gl_id").asc_nulls_last(), F.col("_gl_row").asc()], "rank").where(F.col("rank") <= take)
    return every.join(drawn.select("_gl_row", "rank"), "_gl_row", "left").select(*[F.col("_gl_kept")[c].alias(c) for c in names], *OUT)

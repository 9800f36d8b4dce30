"""Token ids of a corpus in document order, Re-Pair compressed per shard, in blocks that can be read at random."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import repair
from gridloom.llm.common import text_of
from gridloom.llm.tokens import encoder

#: Tokens after which a shard (block) is closed; a document stays whole, so a block exceeds it by one document at most.
SHARD_TOKENS = 1 << 18
#: Bytes of encoded units that a worker remembers; blocks are small, so there is room for them.
MEMORY = 384 << 20
STORE = "part int, block int, docs long, tokens long, body binary"


def _write(spec: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block = encoder(spec, MEMORY), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, null, held, tokens = [], [], [], 0

        def close() -> pa.RecordBatch:
            n = np.array([len(h) // 4 for h in held], np.uint32)
            g = repair.compress(np.frombuffer(b"".join(held), "<u4"))
            body = repair.dump(g, np.array(ids, np.int64), np.array(null, np.uint8), n)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "block", "docs", "tokens", "body"])

        for b in batches:
            texts = b.column("text")
            for k, i in enumerate(b.column("id").to_pylist()):
                held.append(enc.encode(texts[k].as_py()) + end)
                ids.append(i or 0)
                null.append(i is None)
                tokens += len(held[-1]) // 4
                if tokens >= shard_tokens:
                    yield close()
                    block += 1
                    ids, null, held, tokens = [], [], [], 0
        if ids:
            yield close()

    return run


def write_store(
    docs: DataFrame, path: str, spec: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text, append ``end_id``, and write blocks (``repair.dump``) in ascending id order.

    ``spec`` is the tokenizer's JSON. Rows are range-partitioned by id, text hash and row number (so rows that repeat
    an id, or id and text, spread too) and sorted; each task encodes its range in order and closes a block of about ``shard_tokens`` ids at a time,
    so memory is bounded by a block and its largest document. ``part`` and ``block`` give the order; the blocks are
    carried in a Parquet table so that any Hadoop file system can hold them. Null texts are empty, null ids come
    first, texts under one id follow a hash of theirs. An empty table gives an empty store. Ids must be integers.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("r").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.select("id", "text").mapInArrow(_write(spec, end_id, shard_tokens), STORE)
    blocks.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            g, ids, null, tokens = repair.load(b.column("body")[k].as_py())
            flat = repair.expand(g).astype("<u4")
            ends = np.cumsum(tokens, dtype=np.int64)
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]
            n = len(ids)
            cols = [
                pa.array(np.full(n, b.column("part")[k].as_py(), np.int32)), pa.array(np.full(n, b.column("block")[k].as_py(), np.int32)),
                pa.array(ids.astype(np.int64), mask=null.astype(bool)), pa.array(ends - tokens), pa.array(tokens.astype(np.int64)), pa.array(np.array(crc, np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["part", "block", "id", "at", "n_tokens", "ids_crc32"])


def block_starts(store: DataFrame) -> DataFrame:
    """(part, block, start): tokens before each block, by prefix sums in two levels.

    The window over everything runs on one row per written partition; blocks are summed within their partition.
    """
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = store.select("part", "block", "tokens")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    inside = blocks.withColumn("inside", before(W.partitionBy("part").orderBy("block")))
    return inside.join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("start"))


def read_index(store: DataFrame) -> DataFrame:
    """Decode every block -> one row per document: id, start (tokens before it in the corpus), n_tokens, ids_crc32."""
    docs = store.select("part", "block", "body").mapInArrow(_read, "part int, block int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(block_starts(store), ["part", "block"]).select("id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(store: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of the corpus: only the blocks that hold them are read, and only their codes expanded, by the
    tasks; the driver gets the ids that were asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, body in zip(*(b.column(c).to_pylist() for c in ("start", "tokens", "body")), strict=True):
                g, *_ = repair.load(body)
                ids = repair.slice_of(g, max(start - at, 0), min(stop - at, n)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([ids], pa.binary())], ["start", "ids"])

    near = store.join(block_starts(store), ["part", "block"]).where((F.col("start") < stop) & (F.col("start") + F.col("tokens") > start))
    rows = near.select("start", "tokens", "body").mapInArrow(cut, "start long, ids binary").orderBy("start").collect()
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")

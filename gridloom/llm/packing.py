"""Packing documents into windows: minimum bin slack over the histogram of remaining lengths."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import small, text_of, written
from gridloom.llm.tokens import encoder


@dataclass
class Plan:
    """``patterns``: (length -> multiplicity, repeats), each filling windows exactly; ``left``: items of each length
    (the last ones in rank order) that no exact filling took; ``cuts``: where the last, partial stretch is cut."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    left: dict[int, int] = field(default_factory=dict)

    @property
    def left_tokens(self) -> int:
        return sum(k * n for k, n in self.left.items())

    def cuts(self) -> list[int]:
        """Starts of the sequences in the last partial window, at powers of two, which need no padding."""
        rest, at, out = self.left_tokens % self.capacity, 0, []
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                out.append(at)
                at += 1 << bit
        return out


def best_fill(counts: Mapping[int, int], target: int) -> dict[int, int]:
    """Multiset of lengths (length -> how many, within ``counts``) whose sum comes closest to ``target`` from below.

    Subset sums are the bits of an integer; each length enters in powers of two of its count. The bits before each
    step are kept, so the counts come back by walking the steps in reverse.
    """
    full, reach, steps = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= target and counts[x] > 0), reverse=True):
        left, k = min(counts[length], target // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & full
            left, k = left - take, k * 2
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(counts: Mapping[int, int], capacity: int) -> Plan:
    """Minimum bin slack: the longest length left opens a window, ``best_fill`` finds its companions.

    An exact filling is repeated while its lengths last. A length that cannot be filled exactly any more never can
    (counts only fall), so its items are left over. At most two rounds per length, whatever the number of documents.
    """
    now, plan = {k: n for k, n in counts.items() if n > 0}, Plan(capacity)
    while now:
        top = max(now)
        rest = dict(now)
        rest[top] -= 1
        used = best_fill(rest, capacity - top)
        used[top] = used.get(top, 0) + 1
        if sum(k * n for k, n in used.items()) < capacity:
            plan.left[top] = now.pop(top)
            continue
        times = min(now[k] // n for k, n in used.items())
        plan.patterns.append((used, times))
        for k, n in used.items():
            now[k] -= n * times
            if not now[k]:
                del now[k]
    return plan


def _tokenize(spec: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(spec), TaskContext.get().partitionId()
        end, seen, windows = np.array([end_id], "<u4").tobytes(), [0] * capacity, 0
        names = ["part", "id", "doc_tokens", "tail", "tail_rank", "window_rank", "ids"]
        for b in batches:
            texts, rows = b.column("text"), []
            docs = b.column("id")
            for at in range(0, b.num_rows, 256):
                rows = []
                for k in range(at, min(at + 256, b.num_rows)):
                    ids = enc.encode(texts[k].as_py()) + end
                    n = len(ids) // 4
                    tail = n % capacity
                    rows.append((part, n, tail, seen[tail], windows, ids))
                    seen[tail] += 1
                    windows += n // capacity
                c = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(x, t) for x, t in zip(c, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([cols[0], docs.slice(at, 256), *cols[1:]], names)

    return run


def tokenized(docs: DataFrame, spec: str, *, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Written table of every document's ids (binary, 32-bit), and its ranks within the task that made it.

    ``tail``: tokens beyond its full windows; ``tail_rank``: documents of the task with this tail before it;
    ``window_rank``: full windows of the task before it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = "part int, id long, doc_tokens long, tail int, tail_rank long, window_rank long, ids binary"
    return written(rows.mapInArrow(_tokenize(spec, end_id, capacity), schema), "tokens")


def _before(value: str, w) -> F.Column:
    return F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")


def pack(
    docs: DataFrame, spec: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: DataFrame | None = None
) -> DataFrame:
    """Pieces of all documents in sequences of ``capacity`` tokens: id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its text's ids and ``end_id``. Its full windows are sequences of their own; the remaining lengths
    are packed by ``plan_windows`` on their histogram (less than ``capacity`` numbers, the only thing the driver
    sees). Documents of a length are numbered by prefix sums over (task, length) counts; the number names the
    pattern, its repetition and the place in it by a lookup in the plan's table of intervals (bounded by the capacity,
    so broadcast). What no exact filling takes is laid end to end by length and rank and cut at every window; the
    last partial window is cut at powers of two. No sequence needs padding.

    Null and empty texts are documents of the end id alone. Rows that repeat an id are documents of their own. Other
    input columns are not read. An empty table gives an empty one. Which of two documents of equal length takes which
    place depends on how the input is split into tasks; all else does not.
    """
    store = tokens if tokens is not None else tokenized(docs, spec, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)
    spark = store.sparkSession
    by_part = written(store.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("windows")), "lengths")
    counts = {r["tail"]: r["n"] for r in by_part.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # under `capacity` rows
    full = by_part.agg(F.sum("windows").alias("w")).first()["w"] or 0
    plan = plan_windows(counts, capacity)

    lookup: list[tuple] = []  # tail, first rank, end rank, multiplicity, first sequence, offset; multiplicity 0: left over
    used: dict[int, int] = {}
    seq = full
    for pattern, times in plan.patterns:
        at = 0
        for length, m in sorted(pattern.items(), reverse=True):
            start = used.get(length, 0)
            used[length] = start + m * times
            lookup.append((length, start, used[length], m, seq, at))
            at += m * length
        seq += times
    at = 0
    for length, n in sorted(plan.left.items()):
        start = used.get(length, 0)
        lookup.append((length, start, start + n, 0, seq, at))
        at += n * length
    table = spark.createDataFrame(lookup, "tail int, lo long, hi long, m long, seq long, at long")

    # A row per task and length: broadcast while a count shows few, else joined by sorting.
    tails = by_part.select("part", "tail", _before("n", W.partitionBy("tail").orderBy("part")).alias("tail_base"))
    parts = by_part.groupBy("part").agg(F.sum("windows").alias("w")).select("part", _before("w", W.orderBy("part")).alias("window_base"))
    ranks = written(tails.join(small(parts), "part"), "ranks")
    rows = store.join(small(ranks), ["part", "tail"])
    rows = rows.withColumn("rank", F.when(F.col("tail") > 0, F.col("tail_base") + F.col("tail_rank")))
    found = (F.col("t.tail") == F.col("r.tail")) & (F.col("r.rank") >= F.col("t.lo")) & (F.col("r.rank") < F.col("t.hi"))
    rows = rows.alias("r").join(F.broadcast(table).alias("t"), found, "left").drop(F.col("t.tail"))

    cap = F.lit(capacity).cast("long")
    n_full = F.floor(F.col("doc_tokens") / capacity).cast("long")
    piece = lambda start, length, sequence, offset: F.struct(*(x.cast("long").alias(k) for k, x in (("start", start), ("length", length), ("sequence_id", sequence), ("offset", offset))))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    windows = F.when(
        n_full > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), n_full - 1), lambda i: piece(i * cap, cap, F.col("window_base") + F.col("window_rank") + i, F.lit(0))),
    ).otherwise(none)
    place = F.col("rank") - F.col("lo")
    whole = F.array(piece(n_full * cap, F.col("tail"), F.col("seq") + F.floor(place / F.col("m")), F.col("at") + place % F.col("m") * F.col("tail")))
    # Left over: position p in the end-to-end stretch; cut at windows, then at the powers of two of the last one.
    edge = plan.left_tokens // capacity * capacity
    last = F.array(*[F.lit(edge + c).cast("long") for c in plan.cuts()]) if plan.cuts() else F.array().cast("array<bigint>")
    p, q = F.col("at") + place * F.col("tail"), F.col("at") + (place + 1) * F.col("tail")
    next_window = (F.floor(p / capacity) + 1) * cap
    inner = F.filter(F.array_union(F.when(next_window <= edge, F.array(next_window)).otherwise(F.array().cast("array<bigint>")), last), lambda c: (c > p) & (c < q))
    bounds = F.concat(F.array(p), inner, F.array(q))

    def cut(i):
        a, b = F.get(F.col("_gl_bounds"), i), F.get(F.col("_gl_bounds"), i + 1)
        j = F.size(F.filter(last, lambda c: c <= a))
        sequence = F.when(a < edge, F.col("seq") + F.floor(a / capacity)).otherwise(F.col("seq") + edge // capacity + j - 1)
        offset = F.when(a < edge, a % cap).otherwise(a - F.get(last, j - 1))
        return piece(n_full * cap + a - p, b - a, sequence, offset)

    rows = rows.withColumn("_gl_bounds", F.when(F.col("m") == 0, bounds))
    rest = (
        F.when(F.col("tail") == 0, none)
        .when(F.col("m") > 0, whole)
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("_gl_bounds") - 2), cut))
    )
    rows = rows.withColumn("_gl_pieces", F.concat(windows, rest))
    with_ids = F.transform(
        "_gl_pieces", lambda x: F.struct(x.alias("at"), F.substring(F.col("ids"), (x["start"] * 4 + 1).cast("int"), (x["length"] * 4).cast("int")).alias("ids"))
    )
    out = rows.select("id", "doc_tokens", F.explode(with_ids).alias("p"))
    return out.select(F.col("id").alias(id_col), "p.at.start", "p.at.length", "doc_tokens", "p.at.sequence_id", "p.at.offset", F.col("p.ids").alias("ids"))


def sequences(pieces: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Assembled sequences: sequence_id, its ids in order and the pieces' (offset, length) for masks. Bounded rows."""
    part = F.struct("offset", "length", "ids", *columns)
    g = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return g.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))

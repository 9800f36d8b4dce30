"""Ranked lexical search: postings in shards, variable blocks with score bounds, exact search that skips blocks."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import text_of, written

#: Bytes of a term stay (A-Z lower-cased), all others part terms. Bytes from 128 on belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A shard ends with the document that brings it to one of these: about 60 MB while it is searched.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 1_000_000
SHARD = "ids array<long>, lens binary, n_docs long, n_terms long, terms array<binary>, dfs array<int>, docs binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a whole text (UTF-8) in order, repeats included."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Stats:
    """What scores need of the whole corpus: documents with a term, all their terms, documents by term."""

    n_docs: int
    n_terms: int
    df: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.df[term] + 1)))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", terms: frozenset[bytes] | None = None) -> DataFrame:
    """Postings of all rows, written to the shared folder: a row per shard, at most SHARD_DOCS documents and about
    SHARD_POSTINGS postings of neighbouring rows; columns as in SHARD, arrays of numbers as little-endian int32.

    Of each shard: document ids and lengths, its terms in order with their document counts, and for each term the places
    of its documents in the shard, ascending, with its occurrences there. ``terms`` keeps the postings of these terms
    only; lengths and totals count all terms always. No shuffle. Ids are integers (or null); a null text has no
    term; rows that repeat an id or a text are documents of their own. An empty table gives an empty index.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, lens, sizes, at, tf = {}, [], array("i"), array("i"), array("i"), array("i")

        def full() -> pa.RecordBatch:
            term, occurs = np.frombuffer(at, np.int32), np.frombuffer(tf, np.int32)
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.frombuffer(sizes, np.int32))
            order = np.argsort(term, kind="stable")  # documents of a term stay ascending
            n = np.frombuffer(lens, np.int32)
            values = [ids, n.tobytes(), int((n > 0).sum()), int(n.sum(dtype=np.int64)), list(names), np.bincount(term, minlength=len(names)).tolist(), doc[order].tobytes(), occurs[order].tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, values, strict=True))], _ARROW)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                counts = Counter(words if terms is None else filter(terms.__contains__, words))
                ids.append(i)
                lens.append(len(words))
                sizes.append(len(counts))
                at.extend(names.setdefault(t, len(names)) for t in counts)
                tf.extend(counts.values())
                if len(ids) >= SHARD_DOCS or len(at) >= SHARD_POSTINGS:
                    yield full()
                    names, ids, lens, sizes, at, tf = {}, [], array("i"), array("i"), array("i"), array("i")
        if ids:
            yield full()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(shards, SHARD), "index")


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])


def corpus_stats(index: DataFrame, terms: Sequence[bytes]) -> Stats:
    """Totals of the index, and the document counts of ``terms`` (a bounded list)."""
    n = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = held.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return Stats(n["n"] or 0, n["l"] or 0, {bytes(r["term"]): r["df"] for r in df.collect()} if terms else {})


def block_ends(lists: Sequence[tuple[np.ndarray, np.ndarray]], longest: int = 64, fixed: float = 8.0) -> list[np.ndarray]:
    """Where the blocks of each list (documents ascending, scores) end, so that the bound's error is least.

    A block's bound is its largest score and stands for every document from its first to its last; its error is the sum of
    bound less score over these (0 where the term is absent). Each block also costs ``fixed`` mean scores of its list, and
    holds ``longest`` postings at most. Among all partitions the cheapest is found by dynamic programming over posting
    positions, for all lists side by side: with E(i) the least cost of the first i postings, E(i) = min over k of
    E(i - k) + (largest of the last k scores) * (documents from the first of these to the last) + fixed cost, less the sum
    of scores, which is the same for all partitions.
    """
    order = sorted(range(len(lists)), key=lambda k: -len(lists[k][0]))
    sizes = np.array([len(lists[k][0]) for k in order], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    none = [np.zeros(0, np.int64)]
    doc, flat = (np.concatenate([lists[k][c].astype(np.int64) for k in order] or none) for c in (0, 1))
    cost = np.array([max(1, int(fixed * lists[k][1].sum() / max(len(lists[k][1]), 1))) for k in order], np.int64)
    back = np.zeros(len(flat), np.int16)
    top = np.zeros((len(order), longest), np.int64)  # the largest of the last k scores
    begin = np.zeros((len(order), longest), np.int64)  # the document of the first of these
    before = np.full((len(order), longest), np.int64(1) << 61)  # E(i - k)
    before[:, 0] = 0
    live = len(order)
    for i in range(int(sizes[0]) if len(order) else 0):
        while sizes[live - 1] <= i:
            live -= 1
        at = starts[:live] + i
        d, s, t, f, e = doc[at], flat[at], top[:live], begin[:live], before[:live]
        t[:, 1:] = t[:, :-1]
        t[:, 0] = s
        np.maximum(t, s[:, None], out=t)
        f[:, 1:] = f[:, :-1]
        f[:, 0] = d
        total = e + t * (d[:, None] + 1 - f)
        k = total.argmin(axis=1)
        back[at] = k + 1
        best = total[np.arange(live), k] + cost[:live]
        e[:, 1:] = e[:, :-1]
        e[:, 0] = best
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    for at, k in enumerate(order):
        ends, i, b = [], int(sizes[at]), back[starts[at] : starts[at] + sizes[at]].tolist()
        while i:
            ends.append(i)
            i -= b[i - 1]
        out[k] = np.array(ends[::-1], np.int64)
    return out


class Best:
    """The k best (score, document id) seen so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """Scores below it cannot enter; equal ones may, by their id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.null, null]
        keep = np.lexsort((i, n, -s))[: self.k]
        keep = keep[s[keep] > 0]
        self.score, self.id, self.null = s[keep], i[keep], n[keep]


class Shard:
    """One shard made ready for search: scores by posting, blocks and their bounds."""

    def __init__(self, row: dict, stats: Stats, weights: dict[bytes, int]):
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        lens = np.frombuffer(row["lens"], np.int32).astype(np.int64)
        m = 75 + (25 * lens * stats.n_docs) // max(stats.n_terms, 1)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        ends = np.cumsum(row["dfs"]).tolist()
        self.postings: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for t, a, b in zip(row["terms"], [0, *ends], ends, strict=False):
            if w := weights.get(t):
                d, f = docs[a:b], tfs[a:b]
                self.postings[t] = d, w * ((1_000_000_000 * f) // (1000 * f + 12 * m[d]))
        blocks = block_ends(list(self.postings.values()))
        #: For each term: its blocks' first documents, those after their last ones, and their bounds.
        self.blocks: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for (t, (d, s)), e in zip(self.postings.items(), blocks, strict=True):
            first = np.r_[0, e[:-1]]
            self.blocks[t] = d[first], d[e - 1] + 1, np.maximum.reduceat(s, first)

    def search(self, query: Sequence[tuple[bytes, int]], best: Best, batch: int = 256) -> None:
        """Add the shard's documents that belong into ``best``.

        The bound at each document is the sum of the bounds of the blocks that stand there. Ranges whose bound is below
        the k-th best score so far are skipped, the others scored exactly in falling order of their bounds, in batches,
        each of which raises the bar for the next; the search ends at the first bound below it. So it is exact.
        """
        mine = [(t, q) for t, q in query if t in self.postings]
        if not mine:
            return
        bound = np.zeros(len(self.ids) + 1, np.int64)
        for t, q in mine:
            first, end, most = self.blocks[t]
            bound[first] += q * most  # a list's blocks begin at different documents, and end at such
            bound[end] -= q * most
        bound = np.cumsum(bound)[:-1]
        left = np.flatnonzero(bound >= best.bar)
        left = left[np.argsort(-bound[left], kind="stable")]
        while len(left):
            now, left = np.sort(left[:batch]), left[batch:]
            score = np.zeros(len(now), np.int64)
            for t, q in mine:
                d, s = self.postings[t]
                k = np.minimum(np.searchsorted(d, now), len(d) - 1)
                score += np.where(d[k] == now, q * s[k], 0)
            best.add(score, self.ids[now], self.null[now])
            if len(left) and bound[left[0]] < best.bar:
                return
            batch *= 2


def search(index: DataFrame, queries: Sequence[Sequence[tuple[bytes, int]]], stats: Stats, k: int = 20) -> DataFrame:
    """(query int, rank int, doc_id long, score long): the k best documents of each query, a block of queries at a time.

    A task searches its shards one after the other and carries each query's bar along; it returns k rows a query at most,
    which two rounds of windows (by query and a part of the documents, then by query) bring down to k.
    """
    weights = {t: w for t in {t for q in queries for t, _ in q} if t in stats.df and (w := stats.weight(t)) > 0}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for b in batches:
            for n in range(b.num_rows):
                shard = Shard(b.slice(n, 1).to_pylist()[0], stats, weights)
                for q, found in zip(queries, best, strict=True):
                    shard.search(q, found)
        for n, x in enumerate(best):
            if len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.score), n, np.int32)), pa.array(x.id, mask=x.null), pa.array(x.score)], ["query", "doc_id", "score"])

    found = index.select("ids", "lens", "terms", "dfs", "docs", "tfs").mapInArrow(task, "query int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("query", part).orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def query_of(text: str | None) -> list[tuple[bytes, int]]:
    """Distinct terms of a query's whole text with their counts."""
    return sorted(Counter(terms_of((text or "").encode())).items())


def search_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = 5_000, most_terms: int = 500_000
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of all ``docs`` for each row of ``items``, by exact integer scores.

    The weight of a term is floor(1000 * ln((2N + 2) / (2 df + 1))); an occurrence count tf in a document of n terms adds
    weight * (10**9 * tf div (1000 * tf + 12 * m)) with m = 75 + (25 * n * N div L), for each time the item has the term.
    N, L: documents with a term, and all their terms. Only scores above 0 rank; equal ones by ascending id.

    Items go through in blocks of ``block``, so that no task holds more of them. If all items together have
    ``most_terms`` terms at most, the index holds their postings only; else those of all terms.

    Null and empty texts (of either side) have no terms: such documents are never found, such items have no rows. Rows
    that repeat an item are items of their own, rows that repeat a document too (the same id may then rank twice). Texts
    of any length are read whole. Null ids come last among equal scores. Empty tables give an empty result. Other
    columns, whatever their names, play no part.
    """
    spark: SparkSession = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({t for x in b.column(0).to_pylist() for t in terms_of((x or "").encode())}), pa.binary())], ["term"])

    some = asked.select("text").mapInArrow(distinct, "term binary").distinct().limit(most_terms + 1).collect()
    terms = frozenset(bytes(r["term"]) for r in some) if len(some) <= most_terms else None
    index = build_index(docs, id_col=id_col, text_col=text_col, terms=terms)
    out, rows = None, iter(asked.toLocalIterator())
    while batch := list(islice(rows, block)):
        queries = [query_of(r["text"]) for r in batch]
        stats = corpus_stats(index, sorted({t for q in queries for t, _ in q}))
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(batch)], f"query int, item_id {kind}")
        got = search(index, queries, stats, k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

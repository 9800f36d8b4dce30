"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprints (and prefixes of shingle sets, for what it misses),
join on shared keys, verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import golay
from gridloom.llm.common import attach, drop_shuffles, forget, small, text_of, without, written, written_at
from gridloom.llm.components import components

OUT = ("fingerprint", "component_id", "kept")
#: Rows of one key that a task compares at once; larger groups are compared in blocks of half as many.
GROUP_LIMIT = 1 << 15
#: Documents, and bytes, compared at once when a cluster's texts are verified; documents that visit all its blocks.
CLUSTER_BLOCK, CLUSTER_BYTES, HUBS = 256, 16 << 20, 8
#: Shingles that a document offers as candidate keys at least (or all); words in a shingle of the 128-bit SimHash; its
#: bits that are cut into Golay segments, and codewords that a segment keeps.
LEAST_KEYS, SKETCH_WORDS, SOFT_BITS, NEAR = 32, 2, 5 * golay.N, 3
KEYS = "key long, node long, fp long, fp2 long"


def shingles(text: str | None, n: int) -> list[bytes]:
    """Whole text, A-Z lower-cased -> its n-word shingles with repeats; fewer words: all of them; none: no shingle."""
    w = (text or "").encode().lower().split()  # of bytes: ASCII letters, and space and \t..\r only
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64 bits, signed: a bit is set if over half of the shingles' XXH64 values have it; no shingle: zero."""
    s = shingles(text, n)
    if not s:
        return 0
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, s, repeat(seed))), np.uint8).reshape(-1, 8)
    counts = sum(np.unpackbits(hashes[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(s), 65536))
    return int(np.packbits(2 * counts > len(s)).view(">i8")[0])


def fingerprint_column(text_col: str, n: int, seed: int):
    @F.pandas_udf("long")
    def fp(t: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, n, seed) for x in t], dtype="int64")

    return fp(F.col(f"`{text_col}`"))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            rows, keys = golay.hard_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(part[rows])], ["key", "node", "fp"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one or more 64-bit words (rows, words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(node: np.ndarray, fp: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that span the components of a group: breadth first, each step against all that is not yet reached."""
    left, a, b = np.arange(len(node)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _distance(fp[left], fp[at]) <= bits
            new = left[hit]
            a.append(np.full(len(new), node[at]))
            b.append(node[new])
            front.extend(new.tolist())
            left = left[~hit]
    return a, b


def _scan(bits: int, limit: int, words: tuple[str, ...]):
    """Rows sorted by key -> links (a, b) spanning every key's groups, and rows of keys over ``limit`` (with key)."""

    def links(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(key)])
        a, b = [], []
        size_at = np.repeat(sizes, sizes)
        few = np.flatnonzero((size_at > 1) & (size_at <= 4))
        for d in (1, 2, 3):  # small groups, all at once
            i = few[few + d < len(key)]
            i = i[key[i] == key[i + d]]
            i = i[_distance(fp[i], fp[i + d]) <= bits]
            a.append(node[i])
            b.append(node[i + d])
        for s, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
            x, y = _forest(node[s : s + n], fp[s : s + n], bits)
            a += x
            b += y
        a, b = np.concatenate(a), np.concatenate(b)
        return a[a != b], b[a != b]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), pa.int64())] * (1 + len(words))
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *none], ["a", "b", "key", *words])

    def back(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, node, *fp = (pa.array(x) for x in rows)
        return pa.RecordBatch.from_arrays([node, pa.nulls(len(node), pa.int64()), key, *fp], ["a", "b", "key", *words])

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        return out(*links(rows[0], rows[1], np.stack(rows[2:], axis=1).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [np.empty(0, np.int64)] * (2 + len(words)), None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", *words)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if over is not None:  # the rest of a key that is already known to be too large
                n = int(np.searchsorted(held[0], over, "right"))
                yield back([x[:n] for x in held])
                held = [x[n:] for x in held]
                over = over if not len(held[0]) else None
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            if last:
                yield found([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) > limit:
                over = held[0][0]
                yield back(held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield found(held)

    return run


def link_candidates(keys: DataFrame, bits: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, node, fp and perhaps fp2) -> distinct links between nodes that share a key and differ in ``bits`` bits at most.

    Links span the components of each key's rows rather than naming all pairs. A node may stand for several fingerprints. A
    key with over ``limit`` rows is not compared in one task: its rows come back and meet in blocks, every two blocks in a
    task of their own.
    """
    return _linked(keys, bits, limit)[0]


def _linked(keys: DataFrame, bits: int, limit: int = GROUP_LIMIT) -> tuple[DataFrame, str]:
    """``link_candidates``, and the written table that it reads."""
    words = tuple(c for c in ("fp", "fp2") if c in keys.columns)

    def scan(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.select("key", "node", *words).repartition("key").sortWithinPartitions("key", "node")
        return dealt.mapInArrow(_scan(bits, most, words), ", ".join(f"{c} long" for c in ("a", "b", "key", *words)))

    first, path = written_at(scan(keys, limit), "scan")
    links, over = first.where("key IS NULL").select("a", "b"), first.where("key IS NOT NULL").select("key", F.col("a").alias("node"), *words)
    if not over.isEmpty():
        blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (limit // 4)).alias("n"))
        cut = over.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("node", *words), F.col("n")))
        cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        met = cut.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", *words)
        links = links.unionByName(scan(met, 1 << 40).select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), path


def _candidates(keys: DataFrame, bits: int) -> DataFrame:
    """The components (node, root) of the links of keys, written; what it takes to find them is deleted."""
    links, path = _linked(keys, bits)
    out = written(components(links), "clusters")
    forget(keys.sparkSession, path)
    drop_shuffles(keys.sparkSession)
    return out


def mark_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept and the columns in ``carry``.

    Fingerprints link at 3 or fewer differing bits; component_id is the least id that links reach. Equal fingerprints
    are one node, however many rows have them; candidates share a Golay key (``golay.hard_keys`` misses none), and
    every link is verified on the fingerprints. One row of a component is kept: the one with its least id.

    Texts without a word (null, empty) have fingerprint zero and link like any other. Null ids never represent a
    component unless it has no other id (component_id is null then). Of rows that repeat an id, one is kept. Input
    columns named like an output column are replaced. An empty table gives an empty one.
    """
    docs = without(docs, *[c for c in OUT if c.lower() not in (id_col.lower(), text_col.lower())])
    carry = [c for c in carry if c in docs.columns and c != id_col]
    docs = docs.withColumn("_gl_text", text_of(text_col))
    staged = written(
        docs.select(F.monotonically_increasing_id().alias("_gl_row"), F.col(f"`{id_col}`").alias("_gl_id"), fingerprint_column("_gl_text", words, seed).alias("fp"), *[F.col(f"`{c}`") for c in carry]),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("_gl_id").isNull().alias("m"), F.col("_gl_id").alias("id"), F.col("_gl_row").alias("row")))
    nodes = written(staged.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("best")), "nodes")
    keys = nodes.select("fp").mapInArrow(_key_batches, "key long, node long, fp long")
    comp = components(link_candidates(keys, 3))
    linked = nodes.join(comp.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("best").alias("top"))
    tops = linked.select("fp", "root").join(least, "root").select("fp", "top")
    classes = nodes.join(tops, "fp", "left").select("fp", "n", F.coalesce("top", "best").alias("top"))
    rows = attach(staged, written(classes, "classes"), "fp", "n", staged.count())
    return rows.select(
        F.col("_gl_id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("top.id").alias("component_id"),
        (F.col("_gl_row") == F.col("top.row")).alias("kept"),
        *[F.col(f"`{c}`") for c in carry],
    )


def _digests(text: str | None, words: int) -> np.ndarray:
    """64 bits (signed) of each distinct shingle, ascending."""
    s = set(shingles(text, words)) or {b""}
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, s)), np.int64))


def bit_sums(text: str | None, words: int) -> np.ndarray:
    """For each of 128 bits, how many more of the distinct shingles' hashes have it set than not."""
    s = set(shingles(text, words)) or {b""}
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, s)), np.uint8).reshape(-1, 16)
    counts = sum(np.unpackbits(h[i : i + 65536], axis=1).sum(0, dtype=np.int64) for i in range(0, len(h), 65536))
    return 2 * counts - len(h)


def sketches(sums: np.ndarray) -> np.ndarray:
    """Bit sums (n, 128) -> 128-bit SimHashes (n, 2), as signed words."""
    return np.packbits(sums > 0, axis=1).view(">i8").astype(np.int64)


def prefix(u: np.ndarray, similarity: float, common: np.ndarray, least: int = 0) -> np.ndarray:
    """The first of a set's shingles in the order of hashes, sorted ``common`` ones last; ``least`` of them at least.

    Two sets with a Jaccard similarity of ``similarity`` or more share at least ceil(similarity * n) of the n shingles of
    either, so the first n - ceil(similarity * n) + 1 of both, in any order that is the same for all, have one in common.
    """
    if len(common):
        late = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
        u = np.concatenate([u[~late], u[late]])
    return u[: max(len(u) - math.ceil(similarity * len(u) - 1e-9) + 1, least)]


def sketch_column(text: Column) -> Column:
    """128-bit SimHashes and the Golay codewords of their segments."""

    @F.pandas_udf("fp long, fp2 long, top array<int>")
    def found(t: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame({"fp": [], "fp2": [], "top": []})] if not len(t) else []
        for at in range(0, len(t), 512):
            sums = np.stack([bit_sums(x, SKETCH_WORDS) for x in t[at : at + 512]])
            fps, top = sketches(sums), golay.soft_words(sums[:, :SOFT_BITS], NEAR)
            parts.append(pd.DataFrame({"fp": fps[:, 0], "fp2": fps[:, 1], "top": list(top.reshape(len(sums), -1).astype(np.int32))}))
        return pd.concat(parts, ignore_index=True)

    return found(text)


def _keyed(rows: np.ndarray, keys: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    ids, fp, fp2 = (part.column(c).to_numpy()[rows] for c in ("_gl_row", "fp", "fp2"))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids, fp, fp2)], ["key", "node", "fp", "fp2"])


def _golay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            top = part.column("top").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, SOFT_BITS // golay.N, NEAR)
            yield _keyed(*golay.soft_keys(top), part)


def _prefix_batches(words: int, similarity: float, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = [prefix(_digests(t.as_py(), words), similarity, common, LEAST_KEYS) for t in part.column("_gl_text")]
                yield _keyed(np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate(keys), part)

    return run


def common_shingles(texts: DataFrame, words: int, *, rows: int = 20_000, bar: int = 20, most: int = 100_000) -> np.ndarray:
    """Sorted hashes of shingles in ``bar`` or more of about ``rows`` sampled texts. They only order the prefixes (rare
    shingles first keeps groups small), so what a sample misses costs time and no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("_gl_text"):
                yield pa.RecordBatch.from_arrays([pa.array(_digests(t.as_py(), words))], ["key"])

    total = texts.count()
    some = texts.where(F.pmod(F.xxhash64("_gl_row"), F.lit(1 << 40)) < int((1 << 40) * min(1, rows / max(total, 1))))
    n = some.select("_gl_text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bar)
    return np.sort(np.array([r["key"] for r in n.orderBy(F.desc("n"), "key").limit(most).collect()], dtype=np.int64))


class _Block:
    """Texts that a task compares: their shingles as codes, end to end, each text followed by words - 1 empty places.

    Place p of a text stands for its word p, and a shingle covers ``words`` places from its own.
    """

    def __init__(self, texts: Sequence[str], words: int):
        known: dict[bytes, int] = {}
        self.words = words
        self.codes = [np.array([known.setdefault(s, len(known)) for s in shingles(t, words) or [b""]], np.int64) for t in texts]
        self.flat, n = np.concatenate(self.codes), np.array([len(c) for c in self.codes])
        self.length = n + words - 1
        self.starts = np.r_[0, np.cumsum(self.length)[:-1]]
        self.at = np.arange(len(self.flat)) + np.repeat(np.arange(len(n)) * (words - 1), n)
        self.begin = np.r_[0, np.cumsum(n)[:-1]]
        pair = np.repeat(np.arange(len(n)), n) * len(known) + self.flat
        self.first = np.zeros(len(pair), bool)
        self.first[np.unique(pair, return_index=True)[1]] = True
        self.distinct = np.add.reduceat(self.first.astype(np.int64), self.begin)
        self.seen = np.zeros(len(known), bool)

    def _covered(self, hit: np.ndarray, at: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
        found = np.zeros(total + self.words, np.int32)
        found[at + self.words] = hit
        c = np.cumsum(found)
        return np.add.reduceat((c[self.words :] > c[: -self.words]).astype(np.int64), starts)

    def alike(self, k: int, left: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the texts in ``left`` are near-duplicates of text k."""
        own = self.codes[k]
        self.seen[own] = True
        hit = self.seen[self.flat]
        self.seen[own] = False
        met = np.add.reduceat((hit & self.first).astype(np.int64), self.begin)
        sure = met >= similarity * (self.distinct + self.distinct[k] - met) - 1e-9
        there = self._covered(hit, self.at, self.starts, int(self.length.sum())) >= similarity * self.length - 1e-9
        for x in np.flatnonzero(left & there & ~sure):  # and the other way round
            self.seen[self.codes[x]] = True
            back = self._covered(self.seen[own], np.arange(len(own)), np.array([0]), len(own) + self.words - 1)[0]
            self.seen[self.codes[x]] = False
            sure[x] = back >= similarity * self.length[k] - 1e-9
        return np.flatnonzero(left & sure)


def near_duplicates(texts: Sequence[str], words: int = 5, similarity: float = 0.8) -> list[tuple[int, int]]:
    """Places of texts that are linked: spanning the components of ``drop_similar``'s relation, breadth first."""
    block, links, left = _Block(texts, words), [], np.ones(len(texts), bool)
    for seed in range(len(texts)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front and left.any():
            at = front.pop()
            hit = block.alike(at, left, similarity)
            left[hit] = False
            links += [(at, x) for x in hit.tolist()]
            front += hit.tolist()
    return links


def _verified(texts: DataFrame, members: DataFrame, by: Sequence[str], words: int, similarity: float) -> DataFrame:
    """Links between the texts of each group of ``members`` (``by`` and node)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        node = pdf["node"].to_numpy()
        pairs = np.array(near_duplicates(list(pdf["text"]), words, similarity), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    met = texts.select(F.col("_gl_row").alias("node"), F.col("_gl_text").alias("text")).join(small(members), "node")
    return met.groupBy(*by).applyInPandas(run, "a long, b long")


def verified_links(texts: DataFrame, clusters: DataFrame, words: int, similarity: float) -> DataFrame:
    """Candidate clusters (node, root) -> links (a, b) that span the near-duplicates within each of them.

    A cluster is dealt into blocks of CLUSTER_BLOCK documents and CLUSTER_BYTES at most. First, every block is compared
    in itself and with HUBS documents of the cluster that visit all its blocks; in a group of copies this joins (nearly)
    all. Then only documents outside the cluster's largest group so far, the stragglers, meet all its blocks. So the
    pairs between blocks of documents that are known to be linked are never made, and none that could add a link is left out.
    """
    sized = texts.select(F.col("_gl_row").alias("node"), F.octet_length("_gl_text").cast("long").alias("size")).join(small(clusters), "node")
    sized = written(sized.select("root", "node", "size"), "sizes")
    blocks = lambda n, size: F.greatest(F.ceil(n / CLUSTER_BLOCK), F.ceil(size / CLUSTER_BYTES)).cast("long")
    count = F.count(F.lit(1))
    of = written(sized.groupBy("root").agg(count.alias("m"), blocks(count, F.sum("size")).alias("n")), "blocks")
    total = sized.count()
    member = attach(sized, of, "root", "m", total).withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")))
    member = written(member, "members")

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64(F.lit(1), "node"), "node"))
    hubs = member.where("n > 1").select("root", "node", "n", rank.alias("k")).where(F.col("k") <= HUBS)
    visits = written(member.select("root", "i", "node").unionByName(hubs.select("root", each(F.col("n")).alias("i"), "node")), "visits")
    links = written(_verified(texts, visits, ["root", "i"], words, similarity), "verified")

    large = written(member.where("n > 1").select("root", "node", "size", "n", "i"), "large")
    if large.isEmpty():
        return links
    groups = components(links).withColumnRenamed("root", "_gl_top")
    large = large.join(small(groups), "node", "left").withColumn("top", F.coalesce("_gl_top", "node")).drop("_gl_top")
    large = written(large, "large")
    tops = large.groupBy("root", "top").agg(count.alias("m"), F.sum("size").alias("size"))
    main = tops.groupBy("root").agg(F.max_by("top", F.struct("m", "top")).alias("main"), F.sum("m").alias("all"))
    rest = tops.join(main, "root").where("top <> main").groupBy("root").agg(F.max("main").alias("main"), F.max("all").alias("m"), blocks(2 * F.sum("m"), F.sum("size")).alias("s"))
    rest = written(rest, "stragglers")  # one row per cluster that has any
    if rest.isEmpty():
        return links
    open_ = attach(large, rest, "root", "m", total).where("s IS NOT NULL")
    strays = open_.where("top <> main").withColumn("j", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("s")))
    again = strays.select("root", "j", each(F.col("n")).alias("i"), "node").unionByName(open_.select("root", each(F.col("s")).alias("j"), "i", "node"))
    return links.unionByName(_verified(texts, written(again, "again"), ["root", "j", "i"], words, similarity))


def drop_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 44, soft_bits: int = 28, exact: bool = True
) -> DataFrame:
    """One row of each group of near-duplicates (least id, then first row), with the columns of ``docs``.

    Two texts (A-Z lower-cased) are near-duplicates when their common ``words``-word shingles cover a share of
    ``similarity`` or more of the words of both, or when the Jaccard similarity of their sets of shingles is that
    high; groups are the components of that relation. The first finds copies with scattered edits, each of which spoils
    ``words`` shingles and one word.

    Candidates share a Golay key of their 128-bit SimHashes over pairs of words (``golay.soft_words``: five segments, each
    decoded to its three best codewords) and agree in all but ``soft_bits`` of the bits. For the pairs that this misses an
    exact way follows: a shared shingle of their prefixes (``prefix``), which every pair with that Jaccard similarity has;
    of other pairs with shares s of their shingles in common, about exp(-s * LEAST_KEYS) have none. These must agree in
    all but ``bits`` bits, which keeps texts apart that share a passage only (of near-duplicates at the bound some 25 differ, of
    unrelated texts 64). That test has no proof; ``bits=128`` leaves it out, and ``exact=False`` the whole second way. Candidate
    clusters are then verified on the texts (``verified_links``), so a cluster of any size is spread over tasks.

    Null and empty texts, and all without a word, are alike. Null ids lose to any other; of rows that repeat an id and text one
    stays. Texts of any length are read whole. Columns of ``docs`` may have any name. An empty table gives an empty one.
    """
    columns = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    staged = docs.select(F.monotonically_increasing_id().alias("_gl_row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_gl_doc"), sketch_column(text).alias("_gl_sketch"))
    staged = written(staged, "staged")
    texts = staged.select("_gl_row", F.coalesce(F.col("_gl_doc").getField(text_col).cast("string"), F.lit("")).alias("_gl_text"), "_gl_sketch.*")
    clusters = _candidates(texts.select("_gl_row", "fp", "fp2", "top").mapInArrow(_golay_batches, KEYS), soft_bits)
    if exact:
        # What is joined already goes on as one node, so that its copies are not linked again under every key.
        known = texts.drop("top").join(small(clusters.withColumnRenamed("node", "_gl_row")), "_gl_row", "left")
        known = known.select(F.coalesce("root", "_gl_row").alias("_gl_row"), "fp", "fp2", "_gl_text")
        more = _candidates(known.mapInArrow(_prefix_batches(words, similarity, common_shingles(texts, words)), KEYS), bits)
        more = more.select(F.col("node").alias("_gl_node"), F.col("root").alias("_gl_root"))
        joined = clusters.join(small(more), F.col("root") == F.col("_gl_node"), "full")
        clusters = written(joined.select(F.coalesce("node", "_gl_node").alias("node"), F.coalesce("_gl_root", "root").alias("root")), "clusters")
    groups = written(components(verified_links(texts, clusters, words, similarity)), "groups")
    drop_shuffles(docs.sparkSession)
    ids = staged.select(F.col("_gl_row").alias("node"), F.col("_gl_doc").getField(id_col).alias("id")).join(small(groups), "node")
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node").alias("node")))["node"].alias("node"))
    gone = written(groups.select("node").join(best, "node", "left_anti").withColumnRenamed("node", "_gl_row"), "gone")
    return staged.join(small(gone), "_gl_row", "left_anti").select("_gl_doc.*")

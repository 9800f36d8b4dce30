"""URL filtering by association rules over URL tokens, mined with FP-growth, matched by inverted index; and host rules."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import without, written

OUT = ("host", "path", "rule", "verdict", "matched", "confidence")
#: Items in a transaction up to which Spark's FP-growth, which knows no bound on a set's size, lists all frequent sets
#: (2**WIDTH / support at most). Beyond, FP-growth with such a bound grows the same sets.
WIDTH = 12


@dataclass(frozen=True)
class HostRule:
    """Block or allow a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @staticmethod
    def parse(verdict: str, text: str) -> HostRule:
        host, slash, path = text.partition("/")
        return HostRule(verdict, host, slash + path)


@dataclass(frozen=True)
class TokenRule:
    """Tokens that together speak for a bad page."""

    tokens: tuple[str, ...]
    confidence: float
    support: float


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host and their hyphenated parts (h:), path segments that are not numbers (p:),
    names of query parameters (q:)."""
    low = F.lower(F.coalesce(url, F.lit("")))
    part = lambda s, p: F.transform(F.filter(s, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    labels = F.split(host_of(url), r"\.")
    hyphens = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    segments = F.filter(F.split(F.lower(path_of(url)), "/"), lambda x: ~x.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    names = F.transform(F.split(F.regexp_extract(low, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return F.array_distinct(F.concat(part(labels, "h:"), part(hyphens, "h:"), part(segments, "p:"), part(names, "q:")))


def document_of(url: Column) -> Column:
    """The number that ends the path (before an ending or a slash), as long: the document that a page holds; else null."""
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    return F.when(number != "", number.cast("long"))


def frequent_sets(bad: DataFrame, need: int, most: int, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(items array<int>, sorted) -> the sets of ``most`` items at most that ``need`` rows or more have, and how many do, by
    FP-growth: Spark's own where no row has over ``width`` items, else ``grown_sets``."""
    bad = bad.where(F.size("items") > 0)
    n, widest = bad.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if n < need:
        return []
    if widest <= width:
        found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n).fit(bad).freqItemsets.where(F.size("items") <= most)
        return sorted((tuple(sorted(r["items"])), r["freq"]) for r in found.collect())
    return grown_sets(bad, need, most)


def grown_sets(bad: DataFrame, need: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """FP-growth that stops at sets of ``most`` items: conditional tables, grown one item at a time.

    A row (s, p, n) says that n transactions hold the set s and have the items p before its last one, most frequent items
    first; equal rows are merged, as paths of an FP-tree are. Counting the items of p by s gives the frequent sets
    s + x. Then p is pruned to those x, and every x of it opens the table of s + x with what stands before it. A task handles
    rows one by one and counts are pre-aggregated, so no table of a frequent item meets in one task.
    """
    counts = bad.select(F.explode("items").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    rank = {r["x"]: k for k, r in enumerate(sorted(counts.collect(), key=lambda r: (-r["n"], r["x"])))}
    item = {k: x for x, k in rank.items()}

    @F.pandas_udf("array<int>")
    def ranked(items: pd.Series) -> pd.Series:
        return items.map(lambda xs: sorted(rank[x] for x in xs if x in rank))

    table = bad.select(F.array().cast("array<int>").alias("s"), ranked("items").alias("p"))
    table = written(table.where(F.size("p") > 0).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")), "transactions")
    out: list[tuple[tuple[int, ...], int]] = []
    for size in range(1, most + 1):
        level = table.select("s", F.explode("p").alias("x"), "n").groupBy("s", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= need)
        level = written(level, "sets")
        out += [(tuple(sorted(item[k] for k in (*r["s"], r["x"]))), r["n"]) for r in level.collect()]
        if size < most:
            good = level.groupBy("s").agg(F.collect_set("x").alias("good"))
            pruned = table.join(good, "s").select("s", F.array_intersect("p", "good").alias("p"), "n")
            grown = pruned.select("s", "p", "n", F.posexplode("p").alias("i", "x")).where("i > 0")
            table = written(grown.groupBy(F.concat("s", F.array("x")).alias("s"), F.slice("p", F.lit(1), F.col("i")).alias("p")).agg(F.sum("n").alias("n")), "conditional")
    return sorted(out)


def chance(hits: int, n: int, rate: float) -> float:
    """P(at least ``hits`` of ``n``) where each has the probability ``rate``."""
    if rate <= 0 or rate >= 1:
        return float(hits <= 0 or rate >= 1)
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(hits, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def mine_rules(
    urls: DataFrame,
    *,
    url_col: str = "url",
    bad_col: str = "bad",
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    min_count: int = 5,
    max_tokens: int = 3,
    noise: float = 0.05,
    width: int = WIDTH,
) -> list[TokenRule]:
    """Rules token set -> bad from labelled URLs (all of them), by Spark's FP-growth.

    Transactions are the URL tokens of the bad rows. Tokens that the same rows have are one item, so a template with many
    parameters is one too; ``frequent_sets`` lists sets of ``max_tokens`` items at most that reach ``min_support`` (share
    of labelled rows; ``min_count`` rows at least) together with bad, and one pass over all labelled rows counts how many
    have each set. A rule needs ``min_confidence``, and more bad rows than chance gives: at the labelled rows' own share
    of bad ones, a tail of ``noise`` over the number of sets (Bonferroni). Then items become their tokens again, and rules
    with a part that is as confident are dropped. Items number tokens-in-a-URL / ``min_support`` at most, whatever the
    data's size.

    Rows with a null label or null URL are left out; repeated rows count as often as they occur; a URL of any length is
    read whole; rules of equal figures are all kept. An empty table, or no bad row, gives no rule.
    """
    rows = urls.where(F.col(bad_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(bad_col).cast("boolean").alias("bad"), url_tokens(F.col(url_col)).alias("t"))
    rows = written(rows.withColumn("r", F.monotonically_increasing_id()), "transactions")
    total, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    need = max(min_count, math.ceil(min_support * total - 1e-9))
    if n_bad < need:
        return []
    same = [F.bit_xor(F.xxhash64(F.lit(k), "r")).alias(f"s{k}") for k in (1, 2)]
    counts = rows.select("bad", "r", F.explode("t").alias("x")).groupBy("x").agg(F.count_if("bad").alias("b"), F.count(F.lit(1)).alias("n"), *same).where(F.col("b") >= need)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for r in counts.orderBy("x").collect():
        classes[r["n"], r["s1"], r["s2"]].append(r["x"])
    members = list(classes.values())
    item_of = {t: k for k, ts in enumerate(members) for t in ts}

    @F.pandas_udf("array<int>")
    def items(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: sorted({item_of[t] for t in ts if t in item_of}))

    known = written(rows.select("bad", items("t").alias("items")), "items")
    sets = frequent_sets(known.where("bad").select("items"), need, max_tokens, width)
    index: dict[int, list[int]] = defaultdict(list)
    for k, (s, _) in enumerate(sets):
        for x in s:
            index[x].append(k)
    sizes = np.array([len(s) for s, _ in sets])

    def have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sizes), np.int64)
        for b in batches:
            for row in b.column("items").to_pylist():
                hit = np.bincount(np.array([k for x in row for k in index.get(x, ())], np.int64), minlength=len(sizes))
                n += hit == sizes
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])

    rows_with = {r["k"]: r["n"] for r in known.select("items").mapInArrow(have, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()} if sets else {}
    rules = []
    for k, (s, hits) in enumerate(sets):
        n = rows_with[k]
        if hits >= min_confidence * n - 1e-9 and chance(hits, n, n_bad / total) <= noise / len(sets):
            rules += [TokenRule(tuple(sorted(ts)), hits / n, hits / total) for ts in product(*(members[x] for x in s))]
    best: dict[tuple[str, ...], TokenRule] = {}
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens)):
        parts = (best.get(tuple(t for k, t in enumerate(r.tokens) if mask >> k & 1)) for mask in range(1, (1 << len(r.tokens)) - 1))
        if not any(b and b.confidence >= r.confidence for b in parts):
            best[r.tokens] = r
    return list(best.values())


def _matcher(token_rules: Sequence[TokenRule], host_rules: Sequence[HostRule]):
    """Verdicts for a batch. Token rules hang on an inverted index token -> rules; host rules on their host."""
    index: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(token_rules):
        for t in r.tokens:
            index[t].append(k)
    need = [len(r.tokens) for r in token_rules]
    hosts: dict[str, list[HostRule]] = defaultdict(list)
    for h in host_rules:
        hosts[h.host].append(h)

    def host_rule(host: str, path: str) -> HostRule | None:
        labels, hits = host.split("."), []
        for i in range(len(labels)):
            hits += [h for h in hosts.get(".".join(labels[i:]), ()) if path.startswith(h.path)]
        return max(hits, key=lambda h: (len(h.text), len(h.host)), default=None)

    def token_rule(tokens: Sequence[str]) -> TokenRule | None:
        seen: dict[int, int] = defaultdict(int)
        for t in tokens:
            for k in index.get(t, ()):
                seen[k] += 1
        full = [token_rules[k] for k, n in seen.items() if n == need[k]]
        return max(full, key=lambda r: (r.confidence, r.support, r.tokens), default=None)

    @F.pandas_udf("rule string, verdict string, matched string, confidence double")
    def judge(host: pd.Series, path: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for h, p, t in zip(host, path, tokens, strict=True):
            own, mined = host_rule(h, p), token_rule(t)
            by_method = "block" if mined else "allow"
            out.append((own.text if own else None, own.verdict if own else by_method, " ".join(mined.tokens) if mined else None, mined.confidence if mined else None))
        return pd.DataFrame(out, columns=["rule", "verdict", "matched", "confidence"])

    return judge


def judge_urls(pages: DataFrame, token_rules: Sequence[TokenRule], host_rules: Sequence[HostRule], *, url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict (allow or block), matched (the mined rule's tokens) and confidence to every row.

    A host rule fits its host and all subdomains if the path starts with the rule's; the longest wins and decides.
    Else a page is blocked if all tokens of a mined rule are among the URL's; of several the most confident is named.
    A null URL, or one without ://, has empty host and path, no tokens, and is allowed unless a host rule has an empty
    host. Equal rows get equal verdicts, URLs of any length are read whole, of rules with equal figures the one with the
    later tokens is named, and an empty table gives an empty one. Input columns named like an output column are replaced.
    No shuffle.
    """
    url = F.col(f"`{url_col}`")
    pages = without(pages, *[c for c in OUT if c != url_col.lower()])
    judge = _matcher(token_rules, host_rules)
    known = pages.withColumns({"host": host_of(url), "path": path_of(url), "_gl_t": url_tokens(url)})
    return known.withColumn("_gl_v", judge("host", "path", "_gl_t")).select(*known.drop("_gl_t").columns, "_gl_v.*")

"""Rule bitmask ledger: every rule is evaluated once, policies and ablations are bit arithmetic afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_of, without, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; rule k of a list owns bit k of the ledger."""

    name: str
    fails: str


#: Integer arithmetic only, so verdicts do not depend on rounding. Order is part of the ledger's format: append only.
#: Symbols: tables of | cells have up to one for a word and are clean; junk has nearly three.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "2 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
#: A policy version names the rules it enforces.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Bits of a policy."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add MEASURES (long) of every whole text.

    Words are runs of anything but ASCII space and \\t..\\r; lines are split at \\n and count when they hold a word.
    n_repeat_words counts the words that lie in a window of three found twice or more in the text, the first
    occurrence included; hashes tell texts without any such window apart, and in the others the words themselves are
    compared. A null or empty text measures zero throughout; texts of any length are read whole, equal rows measure
    alike, and an empty table gives an empty one. Input columns with these names are replaced. All of it is done within
    the row: no shuffle.
    """
    docs = without(docs, *MEASURES)
    t, w, h, s = (F.col(f"_gl_{c}") for c in ("t", "w", "h", "s"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    # Only a text with a repeated window pays for the sort that brings equal windows together.
    placed = F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, F.lit(3)).alias("g"), i.alias("p"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,g:array<string>,p:int>>"))
    alike = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    twice = F.filter(s, lambda x, i: F.coalesce(alike(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(s, i + 1)), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return (
        docs.withColumn("_gl_t", text_of(text_col))
        .withColumns({"_gl_w": words(t), "_gl_l": lines})
        .withColumn("_gl_h", hashes)
        .withColumn("_gl_s", placed)
        .withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": F.length(F.array_join(w, "")).cast("long"),
                "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
                "n_lines": F.size("_gl_l").cast("long"),
                "n_dup_lines": (F.size("_gl_l") - F.size(F.array_distinct("_gl_l"))).cast("long"),
                "n_repeat_words": covered.cast("long"),
            }
        )
        .drop("_gl_t", "_gl_w", "_gl_l", "_gl_h", "_gl_s")
    )


def ledger(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measurements and ``failures`` (long): bit k is set where rule k fails. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    # Always 0, but not deterministic to the optimizer: a filter on the ledger must not be pushed below the
    # measurements, where every rule would be spelled out again in full.
    bits: Column = F.shiftrightunsigned(F.monotonically_increasing_id(), 63)
    for k, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(without(docs, "failures"), text_col).withColumn("failures", bits)


def verdict(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def keep_passing(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``docs``, whatever their names. Null and empty texts fail where a policy asks
    for words; of equal rows all pass or none; an empty table gives an empty one."""
    led = ledger(docs.withColumn("_gl_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text_col)
    return led.where(verdict(policy)).select("_gl_row.*")


def ablation(led: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of a policy: rows it fails, and rows that only it rejects (kept if it were dropped).

    One aggregation over the ledger; a rule is alone where the masked failures equal its bit. An empty ledger gives
    zero counts.
    """
    m = mask(policy, rules)
    on = [(k, r.name) for k, r in enumerate(rules) if m >> k & 1]
    seen = F.col("failures").bitwiseAND(F.lit(m).cast("long"))
    sums = led.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(seen != 0).alias("rejected"),
        *[F.count_if(F.getbit("failures", F.lit(k)) == 1).alias(f"f{k}") for k, _ in on],
        *[F.count_if(seen == (1 << k)).alias(f"o{k}") for k, _ in on],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("only_this")) for k, n in on])
    return sums.select(F.lit(policy).alias("policy"), "n", "rejected", F.inline(rows))

"""Aggregations: sums, completeness, extents, capacities, scores."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.tables import settled, settled_small, small


def sum_by(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per key (null keys dropped); nulls add nothing and an all-null group is 0."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum(column), F.lit(0.0)).alias(column))


def completeness(df: DataFrame, key: str = "tx_id", column: str = "kva") -> DataFrame:
    """Points, present points and their share per key."""
    d = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("total_points"), F.count(column).alias("non_nan_points"))
    return d.withColumn("fraction_non_nan", F.col("non_nan_points") / F.col("total_points"))


def rank_completeness(df: DataFrame, key: str = "tx_id", column: str = "kva") -> DataFrame:
    return completeness(df, key, column).orderBy(F.desc("fraction_non_nan"), F.desc("total_points"), key)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n"))


def report(df: DataFrame, key: str, ts: str, column: str) -> DataFrame:
    """``overview`` and ``missing`` in one row, by one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(F.col(column).isNull()).alias("n_null"), F.avg(F.col(column).isNotNull().cast("double")).alias("fraction_present"),
    )


def missing(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("n_null"), F.avg(F.col(column).isNotNull().cast("double")).alias("fraction_present"))


def overview(df: DataFrame, key: str, ts: str, column: str) -> DataFrame:
    """One row for logs: rows, keys (nulls not counted), span, nulls."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(F.col(column).isNull()).alias("n_null"),
    )


def interpolated(at: Callable[[Column], Column], n: Column, q: Column) -> Column:
    """The linear-interpolation quantile of n values, the k-th smallest of which is ``at(k)``; null for none.

    The sum is rounded once, like the SQL engine's: where values tie, the last bit decides which of them a bound holds.
    """
    r = q * (n - 1)
    k = F.floor(r).cast("int")
    share = r - F.floor(r)
    between = F.transform(F.array(F.struct(at(k).alias("a"), at(k + 1).alias("b"), share.alias("s"))), lambda t: stats.fused(t["a"], 1 - t["s"], t["s"] * t["b"]))
    return F.when(n > 0, F.when(share == 0, at(k)).otherwise(between[0]))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], qs: Sequence[float], aggs: Sequence[Column] = (), *, hot: int = 1_000_000, bins: int = 256, few: int = 4096
) -> DataFrame:
    """Per group: ``q_<column>`` (array, the exact quantiles ``qs`` of the values that are present and no NaN) and ``aggs``.

    Groups of up to ``hot`` rows sort their values in one task each. A group with more never meets in a task: its ranks
    are cornered by counts. Each pass counts ``bins`` ranges of the interval that holds a rank, for all hot groups, columns
    and ranks at once, and goes on in the range that the rank falls into, until that has ``few`` values or one distinct
    value; only those are gathered. Counts are pre-aggregated, so a pass moves a few numbers per group and task.
    A table of more than ``hot`` rows is read once more to find hot groups (a count by group), and their columns are written
    once if there are any.
    """
    levels = F.array(*[F.lit(float(q)) for q in qs])
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    d = df.withColumn("_k", key)
    values = {c: stats.nan_null(F.col(f"`{c}`").cast("double")) for c in columns}
    back = [F.col("_k")[k].alias(k) for k in keys]

    def cold(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[F.sort_array(F.collect_list(v)).alias(f"_v_{c}") for c, v in values.items()], *aggs)
        of = lambda v: F.transform(levels, lambda q: interpolated(lambda k: F.get(v, k), F.size(v), q))
        found = {f"q_{c}": of(f"_v_{c}") for c in columns}
        return lists.withColumns(found).select(*[F.col(f"`{k}`") for k in keys], *lists.columns[len(keys) + len(columns) :], *found)

    if df.count() <= hot:
        return cold(df)
    big = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(key.alias("_k"))
    if big.isEmpty():
        return cold(df)
    big = settled_small(big)
    rows = settled(d.join(big, "_k", "left_semi").select("_k", F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), v.alias("_x")) for c, v in values.items()]))).where("_x IS NOT NULL"))
    spans = rows.groupBy("_k", "_c").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), F.lit(0).cast("long").alias("_before"), F.count("_x").alias("_n"))
    sizes = settled(spans)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(q)) * (F.col("_n") - 1)), F.ceil(F.lit(float(q)) * (F.col("_n") - 1))) for q in qs])))
    spans = sizes.withColumn("_r", F.explode(ranks))
    where = ["_k", "_c", "_a", "_b", "_before", "_n"]
    while not (wide := spans.where((F.col("_n") > few) & (F.col("_a") < F.col("_b")))).isEmpty():
        inside = rows.join(small(wide.select(*where).distinct()), ["_k", "_c"]).where(F.col("_x").between(F.col("_a"), F.col("_b")))
        share = (F.col("_x") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)  # halves: the width of all doubles overflows
        inside = inside.withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = inside.groupBy(*where, "_bin").agg(F.min("_x").alias("_a2"), F.max("_x").alias("_b2"), F.count("_x").alias("_n2"))
        start = F.coalesce(F.sum("_n2").over(W.partitionBy(*where).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
        counts = counts.withColumn("_start", start)
        hit = wide.join(counts, where).where((F.col("_start") <= F.col("_r")) & (F.col("_r") < F.col("_start") + F.col("_n2")))
        hit = hit.select("_k", "_c", F.col("_a2").alias("_a"), F.col("_b2").alias("_b"), F.col("_start").alias("_before"), F.col("_n2").alias("_n"), "_r")
        spans = settled(spans.where((F.col("_n") <= few) | (F.col("_a") >= F.col("_b"))).unionByName(hit).repartition("_k", "_c"))
    held = rows.join(small(spans.where("_a < _b").select(*where).distinct()), ["_k", "_c"]).where(F.col("_x").between(F.col("_a"), F.col("_b")))
    held = held.groupBy(*where).agg(F.sort_array(F.collect_list("_x")).alias("_v"))  # few values each
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.get("_v", (F.col("_r") - F.col("_before")).cast("int")))
    found = spans.join(held, where, "left").groupBy("_k", "_c").agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_m"))
    found = found.join(sizes.select("_k", "_c", "_n"), ["_k", "_c"])
    found = found.withColumn("_q", F.transform(levels, lambda q: interpolated(lambda k: F.col("_m")[k.cast("long")], F.col("_n"), q)))
    none = F.array(*[F.lit(None).cast("double") for _ in qs])
    wide_q = found.groupBy("_k").agg(*[F.coalesce(F.max(F.when(F.col("_c") == c, F.col("_q"))), none).alias(f"q_{c}") for c in columns])
    others = d.join(big, "_k", "left_semi").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *aggs).drop("_n")
    hot_q = others.join(wide_q, "_k", "left").withColumns({f"q_{c}": F.coalesce(f"q_{c}", none) for c in columns})
    return cold(d.join(big, "_k", "left_anti")).unionByName(hot_q.select(*back, *hot_q.columns[1:]))


def site_quantiles(df: DataFrame, features: Sequence[str], lo: float = 0.1, hi: float = 0.9, group: str = "location") -> DataFrame:
    """Per site and feature: two quantiles, min and max; sites without any value of a feature are left out."""
    bounds = [f(c).alias(f"{c}_{k}") for c in features for k, f in (("min", F.min), ("max", F.max))]
    some = [F.count_if(F.coalesce(*[F.col(c).cast("double") for c in features]).isNotNull()).alias("_some")] if features else []
    out = group_quantiles(df.select(group, *features), [group], features, (lo, hi), [*bounds, *some])
    out = out.where("_some > 0") if features else out
    return out.withColumns({**{f"{c}_lo": F.col(f"q_{c}")[0] for c in features}, **{f"{c}_hi": F.col(f"q_{c}")[1] for c in features}}).drop("_some", *[f"q_{c}" for c in features])


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], bins: int = 4096, few: int = 10_000) -> list[float | None]:
    """Linear-interpolation quantiles of a whole table's finite values, whatever its size; None without any.

    The values around each quantile are cornered by counts per bin: a pass counts ``bins`` ranges of the interval that
    holds a rank, the next one looks into the bin it falls into, until that has ``few`` values or one distinct value. No
    task and not the driver ever holds more than that; a table of a million rows takes three jobs.
    """
    x = F.col(column).cast("double")
    d = df.select(x.alias("x")).where(stats.finite(F.col("x")))
    n, lo, hi = d.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    value: dict[int, float] = {}
    spans = {k: (lo, hi, 0, n) for r in at for k in {math.floor(r), math.ceil(r)}}  # rank -> least, largest, rows before, rows
    while spans:
        for k in [k for k, (a, b, _, _) in spans.items() if a == b]:
            value[k] = spans.pop(k)[0]
        small = {s for s in spans.values() if s[3] <= few}
        if small:
            inside = [F.col("x").between(a, b) for a, b, _, _ in small]
            held = sorted(r["x"] for r in d.where(reduce(or_, inside)).collect())
            for k in [k for k, s in spans.items() if s in small]:
                a, _, before, _ = spans.pop(k)
                value[k] = held[bisect_left(held, a) + k - before]
        if not spans:
            break
        wide = sorted(set(spans.values()))
        place = F.lit(None).cast("int")
        for i, (a, b, _, _) in enumerate(wide):
            share = (F.col("x") / 2 - a / 2) / (b / 2 - a / 2)  # halves: the width of all doubles overflows
            place = F.when(F.col("x").between(a, b), F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int") + i * bins).otherwise(place)
        rows = d.withColumn("p", place).where("p IS NOT NULL").groupBy("p").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("x").alias("n")).orderBy("p").collect()
        for k, (a, b, before, _) in list(spans.items()):
            for r in rows:
                if a <= r["a"] and r["b"] <= b:
                    if k < before + r["n"]:
                        spans[k] = (r["a"], r["b"], before, r["n"])
                        break
                    before += r["n"]
    share = lambda r: r - math.floor(r)
    mixed = lambda a, b, s: math.fma(a, 1 - s, s * b) if math.isfinite(a) and math.isfinite(b) else a * (1 - s) + s * b
    return [value[math.floor(r)] if not share(r) else mixed(value[math.floor(r)], value[math.ceil(r)], share(r)) for r in at]


def impact(df: DataFrame, delta: str = "delta", group: str = "location") -> DataFrame:
    """Mean and 95th percentile of the site's impacts."""
    out = group_quantiles(df.select(group, delta), [group], [delta], (0.95,), [F.avg(delta).alias("mean_impact_mw")])
    return out.select(group, "mean_impact_mw", F.col(f"q_{delta}")[0].alias("p95_impact_mw"))


def peak_difference(df: DataFrame, low: str, high: str, ts: str, keys: Sequence[str], peak: tuple[int, int] = (11, 15)) -> DataFrame:
    """Window value: mean of low - high over peak hours, floored at 0 after the mean; null without a peak row."""
    m = F.avg(F.when(F.hour(ts).between(*peak), F.col(low) - F.col(high)))
    return df.groupBy(*keys).agg(F.when(m.isNotNull(), F.greatest(m, F.lit(0.0))).alias("capacity"))


def site_year(df: DataFrame, value: str = "capacity", keys: Sequence[str] = ("location", "year"), min_windows: int = 15) -> DataFrame:
    """Mean, 90th percentile and count of window values, for keys with enough of them."""
    d = df.where(F.col(value).isNotNull()).select(*keys, value)
    q = group_quantiles(d, keys, [value], (0.9,), [F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_samples")])
    return q.where(F.col("n_samples") >= min_windows).select(*keys, "mean", F.col(f"q_{value}")[0].alias("p90"), "n_samples")


def solar_score(df: DataFrame, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    """Weighted sum; features without a weight, and values that are not finite, add nothing."""
    terms = [F.when(stats.finite(F.col(c).cast("double")), F.col(c) * F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items() if c in df.columns]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return df.withColumn(out, total)


def score_pools(df: DataFrame, score: str = "score", keys: Sequence[str] = (), low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Columns in_low and in_high: finite scores at or beyond the percentiles of their group, or of the whole table."""
    s = F.when(stats.finite(F.col(score)), F.col(score))
    if keys:
        q = group_quantiles(df.select(*keys, s.alias("_s")), keys, ["_s"], (low, high)).withColumnRenamed("q__s", "_q")
        d = df.join(q, list(keys), "left")
    else:
        d = df.withColumn("_q", F.array(*[F.lit(v).cast("double") for v in exact_quantiles(df, score, (low, high))]))
    flag = lambda x: F.coalesce(x, F.lit(False))
    return d.withColumns({"in_low": flag(s <= F.col("_q")[0]), "in_high": flag(s >= F.col("_q")[1])}).drop("_q")


def median_month(df: DataFrame, ts: str = "timestamp", group: str = "location") -> DataFrame:
    return df.groupBy(group).agg(F.percentile(F.month(ts), F.lit(0.5)).cast("int").alias("median_month"))


def feature_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long table of mean, population deviation (0 becomes 1), min and max per feature."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features])
    d = one.select(F.inline(rows)).select("feature", "s.*")
    return d.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def fleet_summary(df: DataFrame, mw: str = "growth_mw", pct: str = "growth_pct", keys: Sequence[str] = ("year",)) -> DataFrame:
    d = df.where(F.col(mw).isNotNull())
    q = group_quantiles(d.select(*keys, mw, pct), keys, [pct], (0.5,), [F.count(F.lit(1)).alias("n_sites"), F.avg(mw).alias("mean_mw"), F.avg(pct).alias("mean_pct"), F.count_if(F.col(mw) > 0).alias("n_positive")])
    return q.select(*keys, "n_sites", "mean_mw", "mean_pct", F.col(f"q_{pct}")[0].alias("median_pct"), "n_positive")


def head_overlap(df: DataFrame, group: str, vector: str, order: str) -> DataFrame:
    """Mean dot product over pairs of a group's vectors (upper triangle); null for one vector.

    The sum over pairs is (|sum of vectors|^2 - sum of |v|^2) / 2, so no pair is formed.
    """
    e = df.select(group, F.posexplode(vector).alias("_k", "_x")).groupBy(group, "_k").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.sum(F.col("_x").cast("double") ** 2).alias("_ss"))
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    t = e.groupBy(group).agg(((F.sum(F.col("_s") ** 2) - F.sum("_ss")) / 2).alias("_t")).join(n, group)
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    return t.select(group, F.when(F.col("_n") > 1, F.col("_t") / pairs).alias("overlap"))

"""Ordered series per site: indices, fills, windows, horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(group: str = "location", ts: str = "timestamp", *ties: str) -> W:
    return W.partitionBy(group).orderBy(F.col(ts).asc_nulls_last(), *ties)


def in_order(df: DataFrame, group: str = "location", ts: str = "timestamp", *ties: str) -> DataFrame:
    """The whole table by (site, time): a range shuffle and sorted files, for outputs that are read in order."""
    return df.orderBy(group, ts, *ties)


def in_order_by_part(df: DataFrame, group: str = "location", ts: str = "timestamp") -> DataFrame:
    """Order within each partition only: no shuffle, and no order between partitions."""
    return df.sortWithinPartitions(group, ts)


def index_between(df: DataFrame, first: int, end: int, index: str = "time_idx") -> DataFrame:
    """Rows first .. end - 1 of every site's index: a slice by number."""
    return df.where((F.col(index) >= first) & (F.col(index) < end))


def half_hour(ts: Column) -> Column:
    """Start of the half hour, in whole numbers from 1970 on: no time zone is looked up."""
    epoch, half = F.lit("1970-01-01").cast("timestamp_ntz"), F.lit(1_800_000_000)
    x = micros(epoch, ts.cast("timestamp_ntz"))
    return half_hour_start(((x - F.pmod(x, half)) / half).cast("int"))


def half_hour_number(ts: Column) -> Column:
    """Half hours since 1970: a whole number to group by, cheaper than the time itself."""
    x, half = micros(F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")), F.lit(1_800_000_000)
    return ((x - F.pmod(x, half)) / half).cast("int")


def half_hour_start(number: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), number * 30)


def micros(a: Column, b: Column) -> Column:
    """Microseconds from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b)


def _in_spans(df: DataFrame, group: str, ts: str, spans: int) -> DataFrame:
    """Add _k: a struct of the site and its time span, one of ``spans`` equal parts of the table's whole time (a row without a
    time is in a last one of its own). Spans of a site follow each other, so what a row needs of earlier ones is one value
    per span."""
    ends = df.agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    share = micros(F.col("_from"), F.col(ts)) / (micros(F.col("_from"), F.col("_to")) + 1)
    span = F.coalesce(F.floor(share * spans).cast("long"), F.lit(spans).cast("long"))
    return df.crossJoin(F.broadcast(ends)).withColumn("_k", F.struct(F.col(group).alias("g"), span.alias("s"))).drop("_from", "_to")


def _carried(sums: DataFrame, before: Column) -> DataFrame:
    """One row per site and span: ``before``, a window function over the spans before, as _carry."""
    return sums.select("_k", before.over(W.partitionBy("_k.g").orderBy("_k.s").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))


def index_by_count(df: DataFrame, group: str = "location", ts: str = "timestamp", out: str = "time_idx", keep: bool = False, spans: int = 1, ties: Sequence[str] = ()) -> DataFrame:
    """0, 1, 2, ... per site in time order; gaps vanish. ``keep`` leaves an index that is there (as long).

    With ``spans`` a site's series is cut into so many spans of time: each is numbered in a task of its own, and the rows of
    the spans before, counted in one pre-aggregated pass, are added. So one site may hold most of the table. The rows
    move once either way. ``ties`` order rows of equal times (else their order is open).
    """
    if keep and out in df.columns:
        return df.withColumn(out, F.col(out).cast("long"))
    if spans <= 1:
        return df.withColumn(out, (F.row_number().over(ordered(group, ts, *ties)) - 1).cast("long"))
    d = _in_spans(df.drop(out), group, ts, spans)
    carry = _carried(d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")), F.sum("_n"))
    place = F.row_number().over(W.partitionBy("_k").orderBy(F.col(ts).asc_nulls_last(), *ties))
    return d.withColumn(out, place).join(carry, "_k").withColumn(out, (F.col(out) - 1 + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_k", "_carry")


def index_from_origin(df: DataFrame, origin: Column, ts: str = "timestamp", out: str = "time_idx", minutes: int = 30, truncate: bool = False) -> DataFrame:
    """Steps since an origin; gaps stay. Floor by default, towards zero with ``truncate``. An index that is there stays."""
    if out in df.columns:
        return df
    steps = micros(origin, F.col(ts)) / F.lit(minutes * 60_000_000)
    return df.withColumn(out, steps.cast("long") if truncate else F.floor(steps).cast("long"))


def index_from_first(df: DataFrame, ts: str = "timestamp", out: str = "time_idx", minutes: int = 30) -> DataFrame:
    """Steps since the earliest timestamp of the whole table (one row, broadcast)."""
    first = df.agg(F.min(ts).alias("_first"))
    return index_from_origin(df.drop(out).crossJoin(F.broadcast(first)), F.col("_first"), ts, out, minutes).drop("_first")


def forward_fill(df: DataFrame, column: str, group: str = "location", ts: str = "timestamp", out: str | None = None, spans: int = 1, ties: Sequence[str] = ()) -> DataFrame:
    """Last value that is present up to here, per site.

    With ``spans`` each span of a site's time is filled in a task of its own, and what is still open at its start takes the last
    value of the spans before, as in ``index_by_count``.
    """
    if spans <= 1:
        w = ordered(group, ts, *ties).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out or column, F.last(column, ignorenulls=True).over(w))
    d = _in_spans(df, group, ts, spans)
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(ts, *ties)))
    carry = _carried(d.groupBy("_k").agg(last.alias("_v")), F.last("_v", ignorenulls=True))
    w = W.partitionBy("_k").orderBy(F.col(ts).asc_nulls_last(), *ties).rowsBetween(W.unboundedPreceding, 0)
    filled = d.withColumn("_f", F.last(column, ignorenulls=True).over(w)).join(carry, "_k")
    return filled.withColumn(out or column, F.coalesce("_f", "_carry")).drop("_k", "_f", "_carry")


def every_nth(df: DataFrame, n: int, group: str = "location", ts: str = "timestamp") -> DataFrame:
    return df.withColumn("_k", F.row_number().over(ordered(group, ts)) - 1).where(F.col("_k") % n == 0).drop("_k")


def window_starts(i: Column, n: Column, size: int, step: int) -> Column:
    """Starts of the windows that hold row i of n: multiples of ``step`` in (i - size, i] below n - size (a window that would fit
    exactly at the end is not one). About size / step of them, by arithmetic alone."""
    whole = lambda x: x - F.pmod(x, F.lit(step))
    first, last = whole(F.greatest(i - F.lit(size - step), F.lit(0))), whole(F.least(i, n - F.lit(size + 1)))
    return F.when((n > size) & (first <= last), F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(df: DataFrame, size: int, step: int, keys: Sequence[str] = ("location",), ts: str = "timestamp", out: str = "window_start") -> DataFrame:
    """Row-count windows per key: each row once for every window that holds it, with the window's start and the row's
    place in it. A row finds its windows by arithmetic, so nothing is joined."""
    w = W.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count(F.lit(1)).over(w)
    d = df.withColumns({"_i": i.cast("long"), "_n": n})
    d = d.withColumn(out, F.explode(window_starts(F.col("_i"), F.col("_n"), size, step)))
    return d.withColumn("place", F.col("_i") - F.col(out)).drop("_i", "_n")


def sequences(df: DataFrame, column: str, encoder: int, horizon: int, group: str = "location", ts: str = "timestamp") -> DataFrame:
    """Encoder and decoder arrays at stride 1: a row per site and first decoder step, full windows only."""
    w = ordered(group, ts)
    past, future = F.collect_list(column).over(w.rowsBetween(-encoder, -1)), F.collect_list(column).over(w.rowsBetween(0, horizon - 1))
    d = df.select(group, ts, past.alias("encoder"), future.alias("decoder"))
    return d.where((F.size("encoder") == encoder) & (F.size("decoder") == horizon))


def explode_horizon(df: DataFrame, array: str = "y_hat", step: str = "horizon_step") -> DataFrame:
    """Prediction arrays to rows; steps from 1."""
    keep = [c for c in df.columns if c != array]
    d = df.select(*keep, F.posexplode(array).alias("_p", array))
    return d.withColumn(step, F.col("_p") + 1).drop("_p")


def warm_up(ts: str, start: Column, end: Column, encoder: int, horizon: int, minutes: int = 30) -> Column:
    """Rows that an encoder needs before ``start`` and a horizon after ``end``."""
    lead, tail = (F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes * n)) for n in (encoder, horizon - 1))
    return F.col(ts).between(start - lead, end + tail)


def latest_first_index(df: DataFrame, group: str = "location", index: str = "time_idx") -> DataFrame:
    """Largest over sites of each site's first index: the boundary from which all sites have history."""
    return df.groupBy(group).agg(F.min(index).alias("first")).agg(F.max("first").alias("boundary"))


def earliest_index(df: DataFrame, index: str = "time_idx", start: Column | None = None) -> DataFrame:
    """Least index from ``start`` on, else the least of all."""
    hit = F.min(F.when(start, F.col(index))) if start is not None else F.min(index)
    return df.agg(F.coalesce(hit, F.min(index)).alias("boundary"))


def split_by_fraction(df: DataFrame, train: float, val: float, index: str = "time_idx") -> DataFrame:
    """Column ``split``: train up to int(max * train), val up to int(max * val), else test."""
    top = df.agg(F.max(index).alias("_max"))
    at = lambda f: F.col(index) <= (F.col("_max") * F.lit(f)).cast("long")
    return df.crossJoin(F.broadcast(top)).withColumn("split", F.when(at(train), "train").when(at(val), "val").otherwise("test")).drop("_max")


def split_by_time(df: DataFrame, train_end: Column, val_end: Column, ts: str = "timestamp", val_start: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows up to ``train_end``; validation rows up to ``val_end``, from ``val_start`` on if one is given."""
    val = F.col(ts) <= val_end
    return df.where(F.col(ts) <= train_end), df.where(val if val_start is None else val & (F.col(ts) >= val_start))


def growth(df: DataFrame, value: str = "mean", group: str = "location", year: str = "year", digits: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """Change from the year before (absolute and percent); null unless both years have a value other than 0 and the
    earlier one is positive. Years must be consecutive."""
    w = W.partitionBy(group).orderBy(year)
    prev, prev_year = F.lag(value).over(w), F.lag(year).over(w)
    d = df.withColumns({"_p": F.when(prev_year == F.col(year) - 1, prev)})
    ok = (F.col("_p") > 0) & (F.col(value) != 0)
    change = F.col(value) - F.col("_p")
    mw, pct = change, change / F.col("_p") * 100
    if digits:
        mw, pct = F.bround(mw, digits[0]), F.bround(pct, digits[1])
    return d.withColumns({"growth_mw": F.when(ok, mw), "growth_pct": F.when(ok, pct)}).drop("_p")


def softplus_scale(df: DataFrame, column: str, group: str = "location") -> DataFrame:
    """Per-site centre and scale of log(1 + exp(x)) values, joined back by a window (approximate normaliser)."""
    w = W.partitionBy(group)
    soft = F.log1p(F.exp(F.col(column)))
    d = df.withColumn("_s", soft).withColumns({"center": F.avg("_s").over(w), "scale": F.stddev_pop("_s").over(w)})
    return d.withColumn("normalised", F.try_divide(F.col("_s") - F.col("center"), F.col("scale"))).drop("_s")

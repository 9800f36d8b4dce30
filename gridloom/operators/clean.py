"""Row and column cleaning: projections, casts, null rules."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.aggregate import exact_quantiles

log = logging.getLogger(__name__)
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise unless all columns are there."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in their order; a warning names the others."""
    have = set(columns)
    if missing := [c for c in wanted if c not in have]:
        log.warning("columns not present: %s", ", ".join(missing))
    return [c for c in wanted if c in have]


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*present(df.columns, list(dict.fromkeys(wanted))))


def without_columns(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """All but the named columns, sorted by name."""
    return df.select(*sorted(set(df.columns) - set(drop)))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is a missing value: make it null in the named (default: all) floating columns, before any aggregate."""
    kinds = dict(df.dtypes)
    use = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in use})


def to_number(df: DataFrame, *columns: str) -> DataFrame:
    """Coerce to double; what cannot be read, and NaN, become null."""
    cast = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(x), x) for c, x in cast.items()})


def to_timestamp(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Coerce text to a naive timestamp and drop rows that cannot be read."""
    x = F.try_to_timestamp(F.col(column), F.lit(fmt)) if fmt else F.col(column).try_cast("timestamp")
    return df.withColumn(column, x.cast("timestamp_ntz")).na.drop(subset=[column])


def to_naive_utc(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """A zoned timestamp becomes its UTC wall time without a zone; a naive one stays."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return df
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    x = F.col(column) if kind == "timestamp" else F.col(column).try_cast("timestamp")
    return df.withColumn(column, F.to_utc_timestamp(x, zone).cast("timestamp_ntz"))


def scale_power(df: DataFrame, factor: float = 0.95, column: str = "kva", out: str = "active_power_kW") -> DataFrame:
    """Real power from apparent power."""
    return df.withColumn(out, F.col(column) * F.lit(factor))


def to_float(df: DataFrame, *columns: str) -> DataFrame:
    """Down-cast numbers to single precision (default: all numeric columns)."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("float") for c in (columns or df.columns) if kinds[c] in NUMBERS})


def to_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, F.col(column).cast("string"))


def rename_prefix(df: DataFrame, rename: Mapping[str, str], prefix: str = "weather_", variables: Sequence[str] = ()) -> DataFrame:
    """Rename coordinates and put a prefix before the variables."""
    return df.withColumnsRenamed({**rename, **{c: prefix + c for c in variables}})


def between(column: str, lo: object, hi: object) -> Column:
    """Closed range."""
    return F.col(column).between(*(x if isinstance(x, Column) else F.lit(x) for x in (lo, hi)))


def half_open(column: str, start: Column, days: int) -> Column:
    """[start, start + days)."""
    return (F.col(column) >= start) & (F.col(column) < start + F.make_dt_interval(F.lit(days)))


def not_in(column: str, values: Sequence[object]) -> Column:
    """Not one of the values; a null is kept."""
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def hours(column: str, lo: int, hi: int) -> Column:
    return F.hour(column).between(lo, hi)


def months(column: str, lo: int, hi: int) -> Column:
    return F.month(column).between(lo, hi)


def extreme_rows(df: DataFrame, column: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or below the low quantile, and at or above the high one; the bounds are plain numbers that reach the scan."""
    lo, hi = (F.lit(v).cast("double") for v in exact_quantiles(df, column, (low, high)))
    return df.where(F.col(column) <= lo), df.where(F.col(column) >= hi)

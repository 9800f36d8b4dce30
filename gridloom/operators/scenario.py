"""Counterfactual weather: site bounds pushed to high and low sun, written into daylight rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.operators.aggregate import site_quantiles
from gridloom.tables import settled_small

# Name parts that tell a feature's class, and parts that mark a derived sibling.
CLOUD_PARTS = ("tcc", "cloud", "cloud_cover", "total_cloud_cover")
ZENITH_PARTS = ("solar_zenith_angle", "zenith_angle")
SIBLING_PARTS = ("lag", "roll", "diff")


def inverted(feature: str) -> bool:
    """Features that are low when the sun is strong."""
    return any(p in feature for p in CLOUD_PARTS + ZENITH_PARTS)


def push(value: Column, factor: float, lo: Column, hi: Column) -> Column:
    """Scaled and kept within the observed bounds."""
    return stats.clip(value * F.lit(factor), lo, hi)


def coherent_mods(df: DataFrame, features: Sequence[str], lo: float = 0.1, hi: float = 0.9, push_lo: float = 0.9, push_hi: float = 1.1, group: str = "location") -> DataFrame:
    """One row per site: <feature>_low_sun and <feature>_high_sun. Sites without any value are left out."""
    q = site_quantiles(df, features, lo, hi, group)
    out = {}
    for c in features:
        bounds = F.col(f"{c}_min"), F.col(f"{c}_max")
        down, up = push(F.col(f"{c}_lo"), push_lo, *bounds), push(F.col(f"{c}_hi"), push_hi, *bounds)
        out[f"{c}_low_sun"], out[f"{c}_high_sun"] = (up, down) if inverted(c) else (down, up)
    return q.select(group, *[v.alias(k) for k, v in out.items()])


def overwrite_daylight(df: DataFrame, values: Mapping[str, Column], ts: str = "timestamp", daylight: tuple[int, int] = (6, 19)) -> DataFrame:
    """Replace columns inside daylight hours (inclusive) only; unknown names are ignored."""
    day = F.hour(ts).between(*daylight)
    return df.withColumns({c: F.when(day, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def with_siblings(columns: Sequence[str], mods: Mapping[str, Column]) -> dict[str, Column]:
    """Mods, and each one's derived siblings (its name first, a sibling part anywhere); later ones win."""
    out: dict[str, Column] = {}
    for k, v in mods.items():
        if k in columns:
            out[k] = v
            out.update({c: v for c in columns if c != k and c.startswith(k) and any(p in c for p in SIBLING_PARTS)})
    return out


def apply_constants(df: DataFrame, mods: Mapping[str, float], ts: str = "timestamp", daylight: tuple[int, int] = (6, 19), siblings: bool = False) -> DataFrame:
    """Constant values in daylight, with their siblings if asked for."""
    values = {k: F.lit(float(v)) for k, v in mods.items()}
    return overwrite_daylight(df, with_siblings(df.columns, values) if siblings else values, ts, daylight)


def scenario_pair(df: DataFrame, mods: DataFrame, features: Sequence[str], ts: str = "timestamp", group: str = "location", daylight: tuple[int, int] = (6, 19)) -> tuple[DataFrame, DataFrame]:
    """Tables under low and high sun, from per-site mods (a row per site), computed once and broadcast after a count, so that the
    series does not move."""
    j = df.join(settled_small(mods), group)
    own = df.columns
    side = lambda s: overwrite_daylight(j, {c: F.col(f"{c}_{s}_sun") for c in features}, ts, daylight).select(*own)
    return side("low"), side("high")


def signed_delta(high: Column, low: Column, orientation: Column) -> Column:
    """High minus low, the other way round where output falls with the sun, floored at 0; null if either is missing."""
    d = F.when(orientation > 0, high - low).otherwise(low - high)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


def standardise(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / std by a long scaler table (one row per feature, turned into one row)."""
    s = _wide(scaler, features)
    d = df.crossJoin(F.broadcast(s))
    return d.withColumns({c: (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"] for c in features}).drop("_s")


def unstandardise(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Back to units, clipped to the observed bounds."""
    d = df.crossJoin(F.broadcast(_wide(scaler, features)))
    s = lambda c, k: F.col("_s")[c][k]
    return d.withColumns({c: stats.clip(F.col(c) * s(c, "std") + s(c, "mean"), s(c, "min"), s(c, "max")) for c in features}).drop("_s")


def _wide(scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    entry = F.struct("feature", F.struct("mean", "std", "min", "max"))
    return scaler.where(F.col("feature").isin(list(features))).agg(F.map_from_entries(F.collect_list(entry)).alias("_s"))

"""Three counterfactual estimators of hidden solar capacity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.models import Scorer
from gridloom.operators import aggregate, clean, sampling, scenario, timeseries
from gridloom.tables import settled, settled_small, small


def brute_force(df: DataFrame, scorer: Scorer, features: Sequence[str], *, ts: str = "timestamp", group: str = "location", daylight: tuple[int, int] = (6, 19), **mods) -> DataFrame:
    """Site quantiles pushed to high and low sun: mean and p95 of the clipped difference per site.

    Both scenarios ride on one row (two sets of columns), so predictions are never joined back.
    """
    use = clean.present(df.columns, features)
    j = df.join(settled_small(scenario.coherent_mods(df, use, group=group, **mods)), group)  # a row per site
    day = F.hour(ts).between(*daylight)
    for side in ("low", "high"):
        own = {c: F.when(day, F.col(f"{c}_{side}_sun")).otherwise(F.col(c)) for c in use}
        keep = j.withColumns({f"_own_{c}": F.col(c) for c in use})
        j = scorer.score(keep.withColumns(own), f"y_{side}").withColumns({c: F.col(f"_own_{c}") for c in use}).drop(*[f"_own_{c}" for c in use])
    d = j.withColumn("delta", scenario.signed_delta(F.col("y_high"), F.col("y_low"), F.lit(1)))
    return aggregate.impact(d, "delta", group)


@dataclass(frozen=True)
class AnalogueConfig:
    window: int = 432
    encoder: int = 336
    step: int = 336
    min_samples: int = 1000
    min_windows: int = 15
    peak: tuple[int, int] = (11, 15)
    low: float = 0.05
    high: float = 0.95
    irradiance: str = "ssrd_w_m2"
    fallback_years: tuple[int, ...] = (2021, 2022)


def analogue_year_table(df: DataFrame, ts: str, fallback: Sequence[int]) -> DataFrame:
    """(year, analogue_year) for the years of a table, without a look at them on the driver. The window runs over one row per year."""
    years = df.select(F.year(ts).alias("year")).where("year IS NOT NULL").distinct().withColumn("_first", F.min("year").over(W.partitionBy()))
    before = F.when(F.col("year") == F.col("_first"), F.array(*[F.lit(y) for y in fallback])).otherwise(F.array(F.col("year") - 2, F.col("year") - 1))
    return years.select("year", F.explode(before).alias("analogue_year"))


def analogue_years(years: Sequence[int], fallback: Sequence[int]) -> list[tuple[int, int]]:
    """(year, analogue year): the two years before, the fallback for the first."""
    return [(y, a) for k, y in enumerate(years) for a in (fallback if k == 0 else (y - 2, y - 1))]


def historical_analogue(
    df: DataFrame, scorer: Scorer, features: Sequence[str], years: Sequence[int], cfg: AnalogueConfig = AnalogueConfig(), *,  # noqa: B008
    ts: str = "timestamp", group: str = "location", pick: Column | None = None,
) -> DataFrame:
    """(location, year, mean, p90, n_samples, growth): windows of a year under weather of extreme analogue hours.

    All years go through together: each has one low and one high library row per hour (least ``pick``, by default a hash)
    and one of each for hours without any, 25 rows a year, joined by broadcast. Both scenarios ride on one row, so
    windows are made once and predictions are never joined.
    """
    use = clean.present(df.columns, features)
    pairs = df.sparkSession.createDataFrame(analogue_years(years, cfg.fallback_years), "year int, _a int")
    pick = pick if pick is not None else F.xxhash64(F.lit(42), *use)
    lib = df.withColumns({"_a": F.year(ts), "_k": pick}).join(F.broadcast(pairs), "_a")
    seen = lib.where(stats.finite(F.col(cfg.irradiance))).select("year", cfg.irradiance)
    bounds = aggregate.group_quantiles(seen, ["year"], [cfg.irradiance], (cfg.low, cfg.high)).select("year", *[F.col(f"q_{cfg.irradiance}")[i].alias(c) for i, c in enumerate(("_lo", "_hi"))])
    lib = lib.join(settled_small(bounds), "year")  # a row per year, all years at once
    sides = {"low": F.col(cfg.irradiance) <= F.col("_lo"), "high": F.col(cfg.irradiance) >= F.col("_hi")}
    chosen = [F.min_by(F.struct(*use), F.when(on, F.col("_k"))).alias(s) for s, on in sides.items()]
    by_hour = lib.groupBy("year", F.hour(ts).alias("_h")).agg(*chosen)
    others = lib.groupBy("year").agg(*chosen).withColumnsRenamed({s: f"any_{s}" for s in sides})

    own = df.withColumn("year", F.year(ts)).where(F.col("year").isin(list(years)))
    enough = own.groupBy(group, "year").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cfg.min_samples)
    own = own.join(enough.drop("_n"), [group, "year"], "left_semi")
    w = timeseries.sliding_windows(own, cfg.window, cfg.step, (group, "year"), ts).where(F.col("place") >= cfg.encoder)
    w = w.withColumn("_h", F.hour(ts)).join(F.broadcast(by_hour), ["year", "_h"], "left").join(F.broadcast(others), "year", "left")
    for side in sides:
        best = F.coalesce(side, f"any_{side}")
        w = scorer.score(w.withColumns({c: best[c] for c in use}), f"y_{side}")
    cap = aggregate.peak_difference(w, "y_low", "y_high", ts, [group, "year", "window_start"], cfg.peak)
    out = aggregate.site_year(cap, keys=(group, "year"), min_windows=cfg.min_windows)
    out = out.withColumns({"mean": F.bround("mean", 4), "p90": F.bround("p90", 4)})
    return timeseries.growth(out, "mean", group, "year")


def calibration(df: DataFrame, y: str, x: str, group: str = "location", min_rows: int = 10) -> DataFrame:
    """Trimmed calibration per site: finite pairs, y within its own 1st to 99th percentile, identity as the fallback."""
    d = df.where(stats.finite(F.col(x)) & stats.finite(F.col(y)))
    q = aggregate.group_quantiles(d.select(group, y), [group], [y], (0.01, 0.99), [F.count(F.lit(1)).alias("_n")]).withColumnRenamed(f"q_{y}", "_q")
    q = settled_small(q)
    a, b = stats.slope_intercept(F.col(y), F.col(x))
    c = d.join(q, group).where(F.col(y).between(F.col("_q")[0], F.col("_q")[1])).groupBy(group).agg(F.first("_n").alias("_n"), a.alias("_a"), b.alias("_b"))
    ok = (F.col("_n") >= min_rows) & stats.finite(F.col("_a"))
    return c.select(group, F.when(ok, F.col("_a")).otherwise(F.lit(1.0)).alias("slope"), F.when(ok, F.col("_b")).otherwise(F.lit(0.0)).alias("intercept"))


def widen(result: DataFrame, years: Sequence[int], group: str = "location") -> DataFrame:
    """One row per site: capacity_<y>_mean, capacity_<y>_p90, n_samples_<y>, growth_<a>_<b>_mw and _pct."""
    aggs = []
    for k, y in enumerate(years):
        at = lambda c, y=y: F.max(F.when(F.col("year") == y, F.col(c)))
        aggs += [at("mean").alias(f"capacity_{y}_mean"), at("p90").alias(f"capacity_{y}_p90"), F.coalesce(at("n_samples"), F.lit(0)).alias(f"n_samples_{y}")]
        if k:
            aggs += [at("growth_mw").alias(f"growth_{years[k - 1]}_{y}_mw"), at("growth_pct").alias(f"growth_{years[k - 1]}_{y}_pct")]
    return result.groupBy(group).agg(*aggs)


def on_manifold(
    df: DataFrame, scorer: Scorer, weights: Mapping[str, float], *, target: str, primary: str, slope: float = 1.0, intercept: float = 0.0, k: int = 64, draws: int = 20,
    ts: str = "timestamp", group: str = "location", daylight: tuple[int, int] = (6, 19), seed: int = 42, low: float = 0.2, high: float = 0.8,
) -> DataFrame:
    """Draws of real weather rows (site, its median month, hour 12) from low- and high-score pools, overwritten in
    daylight, scored, calibrated and differenced by the site's orientation: mean and p95 per site.

    The sampler is empirical (historical rows), not a generative model; draws are keyed by a seeded hash. Weights are
    required.
    """
    use = [c for c in weights if c in df.columns]
    if not use:
        raise ValueError("none of the weighted features is present")
    summer_noon = F.month(ts).between(5, 9) & F.hour(ts).between(11, 14)
    orient = stats.orientation_negative(*(F.when(summer_noon, F.col(c)) for c in (primary, target)))
    sites = df.groupBy(group).agg(F.percentile(F.month(ts), F.lit(0.5)).cast("int").alias("median_month"), orient.alias("orientation"))
    sites = settled(sites)
    noon = df.where(F.hour(ts) == 12).join(small(sites.select(group, "median_month")), group).where(F.month(ts) == F.col("median_month")).select(group, ts, *use)
    cand = aggregate.score_pools(aggregate.solar_score(sampling.candidates(noon, [group], k, [group, ts], seed), weights), keys=(group,), low=low, high=high)
    vec = settled(cand.withColumn("v", F.struct(*use)))  # k rows per site
    d_low = sampling.draw_from_pool(sites.select(group), vec.where("in_low"), draws, group, "v", "candidate", seed, "v_low")
    d_high = sampling.draw_from_pool(sites.select(group), vec.where("in_high"), draws, group, "v", "candidate", seed + 1, "v_high")
    drawn = settled(d_low.join(d_high, [group, "draw"]).join(sites.select(group, "orientation"), group))  # ``draws`` rows per site
    j = df.join(small(drawn), group)
    for side in ("low", "high"):
        mods = scenario.with_siblings(df.columns, {c: F.col(f"v_{side}")[c] for c in use})
        saved = {f"_own_{c}": F.col(c) for c in mods}
        j = scorer.score(scenario.overwrite_daylight(j.withColumns(saved), mods, ts, daylight), f"y_{side}")
        j = j.withColumns({c: F.col(f"_own_{c}") for c in mods}).drop(*saved)
    cal = lambda c: F.lit(slope) * F.col(c) + F.lit(intercept)
    d = j.withColumn("delta", scenario.signed_delta(cal("y_high"), cal("y_low"), F.col("orientation")))
    return aggregate.impact(settled(d.select(group, "delta")), "delta", group)

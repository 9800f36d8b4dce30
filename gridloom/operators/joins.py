"""Joins of the merge and matching steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.tables import settled

#: Sides of up to so many rows are broadcast after a count; beyond, Spark's own choice stands.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a side of narrow rows whose number is checked first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def on_grid(x: Column, step: float = 0.25) -> Column:
    """A coordinate as a whole number of grid steps: floats from different sources meet."""
    return F.round(x.cast("double") / step).cast("long")


def _cells(d: DataFrame, step: float, lat: str, lon: str) -> DataFrame:
    return d.withColumns({"_lat": on_grid(F.col(lat), step), "_lon": on_grid(F.col(lon), step)})


def weather_to_sites(weather: DataFrame, mapping: DataFrame, step: float = 0.25, lat: str = "era5_lat", lon: str = "era5_lon") -> DataFrame:
    """Inner join of grid cells to the sites mapped to them, on coordinates in grid steps; the site's coordinates stay."""
    return _cells(weather, step, lat, lon).drop(lat, lon).join(small(_cells(mapping, step, lat, lon)), ["_lat", "_lon"], "inner").drop("_lat", "_lon")


def power_to_weather(power: DataFrame, weather: DataFrame) -> DataFrame:
    """Inner join on (location, timestamp)."""
    return power.join(weather, ["location", "timestamp"], "inner")


def power_to_cells(power: DataFrame, mapping: DataFrame, weather: DataFrame, step: float = 0.25, lat: str = "era5_lat", lon: str = "era5_lon") -> DataFrame:
    """The rows of ``power_to_weather(power, weather_to_sites(weather, mapping))``, joined the other way round.

    Power takes its site's cell first and then meets the weather of its cell and time. So a row of weather is not repeated for
    every site of its cell, with a reading at that time or not: their product grows with the square of the table.
    """
    located = power.join(small(_cells(mapping, step, lat, lon)), "location", "inner")
    d = located.join(_cells(weather, step, lat, lon).drop(lat, lon), ["_lat", "_lon", "timestamp"], "inner")
    of = lambda df, *but: [c for c in df.columns if c not in ("location", "timestamp", *but)]
    return d.select("location", "timestamp", *of(power), *of(weather, lat, lon), *of(mapping))


def attach_coordinates(agg: DataFrame, matches: DataFrame, key: str = "location_name") -> DataFrame:
    """Left join of the distinct (key, longitude, latitude) rows."""
    return agg.join(matches.select(key, "longitude", "latitude").distinct(), key, "left")


def best_match(left: DataFrame, right: DataFrame, threshold: float, name: str = "location_name", geo: str = "geo_name") -> DataFrame:
    """Best token-Jaccard match of each distinct name; first right row (by ``pos``) wins ties; null where none passes.

    Of n tokens a match shares ceil(threshold * n) at least, so in any common order of tokens the first
    n - ceil(threshold * n) + 1 of both sides have one in common. With rare tokens first, words that every name has do
    not bring all pairs together. Pairs that share such a token are compared on their whole token sets. ``right`` has
    ``pos`` (its row order). Scores of 0 never match. Right rows of one name tie, so only the first of each distinct name
    is compared.
    """
    names = settled(left.select(F.col(name).alias("_l")).distinct().withColumn("_t", text.tokens(F.col("_l"))))
    rows = settled(right.groupBy(F.col(geo).alias("_r")).agg(F.min("pos").alias("pos")).withColumn("_u", text.tokens(F.col("_r"))))
    counts = names.select(F.explode("_t").alias("_k")).unionAll(rows.select(F.explode("_u").alias("_k"))).groupBy("_k").agg(F.count(F.lit(1)).alias("_c"))
    counts = settled(counts)

    def prefix(d: DataFrame, key: str, tokens: str) -> DataFrame:
        ranked = d.select(key, F.size(tokens).alias("_n"), F.explode(tokens).alias("_k")).join(counts, "_k")
        place = F.row_number().over(W.partitionBy(key).orderBy("_c", "_k"))
        return ranked.withColumn("_p", place).where(F.col("_p") <= F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n") - 1e-9) + 1).select(key, "_k")

    met = prefix(names, "_l", "_t").join(prefix(rows, "pos", "_u"), "_k").select("_l", "pos").distinct()
    pairs = met.join(names, "_l").join(rows.select("pos", "_u"), "pos")
    overlap = F.size(F.array_intersect("_t", "_u"))
    pairs = pairs.select("_l", "pos", (overlap / (F.size("_t") + F.size("_u") - overlap)).alias("score"))
    best = pairs.groupBy("_l").agg(F.max(F.struct("score", (-F.col("pos")).alias("neg"))).alias("_b"))
    best = best.select("_l", F.col("_b.score").alias("score"), (-F.col("_b.neg")).alias("pos")).where(F.col("score") >= threshold)
    hit = best.join(right, "pos").drop("pos").withColumnRenamed(geo, "matched_geo_name")
    return names.select("_l").join(hit, "_l", "left").withColumnRenamed("_l", name)


def matched(best: DataFrame) -> DataFrame:
    return best.where(F.col("score").isNotNull())


def unmatched(best: DataFrame, name: str = "location_name") -> DataFrame:
    return best.where(F.col("score").isNull()).select(name)


def lookup_first(rows: DataFrame, table: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Inner lookup; of several table rows with a key the first by ``order`` counts."""
    first = table.groupBy(*keys).agg(F.min_by(value, order).alias(value))
    return rows.join(first.where(F.col(value).isNotNull()), keys, "inner")


def lookup_last(rows: DataFrame, table: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Inner lookup; of several table rows with a key the last by ``order`` counts."""
    last = table.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    return rows.join(last.where(F.col(value).isNotNull()), keys, "inner")


def high_low(high: DataFrame, low: DataFrame, value: str = "y_hat", keys: tuple[str, ...] = ("location", "timestamp", "horizon_step")) -> DataFrame:
    """Two scenarios side by side, by key and never by position."""
    rename = lambda d, s: d.select(*keys, F.col(value).alias(f"{value}_{s}"))
    return rename(high, "max").join(rename(low, "min"), list(keys), "inner")


def hour_analogue(base: DataFrame, library: DataFrame, features: list[str], ts: str = "timestamp", pick: Column | None = None) -> DataFrame:
    """Each row takes the features of the library row chosen for its hour (least ``pick``), else of the overall choice.

    24 rows and a fallback, found by one pre-aggregated pass over the library, whatever its size.
    """
    pick = pick if pick is not None else F.xxhash64(F.lit(42), *features)
    row = F.struct(*features)
    lib = library.select(F.hour(ts).alias("_h"), row.alias("_f"), pick.alias("_k"))
    by_hour = lib.groupBy("_h").agg(F.min_by("_f", "_k").alias("_f"))
    other = lib.agg(F.min_by("_f", "_k").alias("_any"))
    d = base.withColumn("_h", F.hour(ts)).join(F.broadcast(by_hour), "_h", "left").crossJoin(F.broadcast(other))
    chosen = F.coalesce("_f", "_any")
    return d.withColumns({f: chosen[f] for f in features}).drop("_h", "_f", "_any")


def label_ids(df: DataFrame, column: str, out: str = "label_id") -> DataFrame:
    """0, 1, ... by sorted distinct value. The global window runs over distinct labels only."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, (F.dense_rank().over(W.orderBy(column)) - 1).cast("long"))
    return df.join(small(ids), column, "left")


def trained_only(df: DataFrame, trained: DataFrame, key: str = "location") -> DataFrame:
    return df.join(trained.select(key).distinct(), key, "left_semi")


def unseen_only(df: DataFrame, trained: DataFrame, key: str = "location") -> DataFrame:
    return df.join(trained.select(key).distinct(), key, "left_anti")


def proxy_unseen(df: DataFrame, trained: DataFrame, key: str = "location", out: str = "model_location") -> DataFrame:
    """A trained site stands for itself, any other one for the trained site at its hash (sorted order, modulo)."""
    sites = trained.select(F.col(key).cast("string").alias("_s")).where("_s IS NOT NULL").distinct()
    numbered = sites.withColumn("_i", (F.row_number().over(W.orderBy("_s")) - 1).cast("int"))
    n = sites.agg(F.count(F.lit(1)).alias("_n"))
    d = df.crossJoin(F.broadcast(n)).withColumn("_i", F.when(F.col("_n") > 0, F.pmod(text.stable_number(F.col(key)), F.greatest("_n", F.lit(1)))).cast("int"))
    own = numbered.select(F.col("_s").alias("_own"))
    d = d.join(small(own), F.col(key).cast("string") == F.col("_own"), "left").join(small(numbered), "_i", "left")
    return d.withColumn(out, F.coalesce("_own", "_s")).drop("_i", "_n", "_own", "_s")

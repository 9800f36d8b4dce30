"""Registered queries of the series operators, with the DuckDB SQL that must give the same rows.

``events`` stands for a power series (user: site, value: reading), ``orders`` for one of many years. Gaps are made where
event_type is 'error'; weather columns are arithmetic on the event. Windows are scaled to the series' length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions import stats, text
from gridloom.models import DampedTrend, LinearScorer, boost
from gridloom.operators import aggregate, clean, generate, joins, sampling, scenario, sets, timeseries
from gridloom.plans import capacity, forecast, ingest, merge, reports
from gridloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WEATHER = ("ssrd_w_m2", "tcc", "solar_zenith_angle", "t2m_c")
MODEL = LinearScorer({"ssrd_w_m2": 0.01, "tcc": -0.5, "solar_zenith_angle": -0.02, "t2m_c": 0.1, "ssrd_w_m2_lag_2h": 0.005}, 1.0)
Y = "(1.0::DOUBLE + ssrd_w_m2 * 0.01::DOUBLE + tcc * (-0.5)::DOUBLE + solar_zenith_angle * (-0.02)::DOUBLE + t2m_c * 0.1::DOUBLE + ssrd_w_m2_lag_2h * 0.005::DOUBLE)"

#: The series in SQL: a common table expression that queries start from.
S = """s AS (SELECT event_id, cast(user_id AS VARCHAR) AS location, ts AS timestamp, value AS kva, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS gap, event_type, props,
  value * 8.0::DOUBLE AS ssrd_w_m2, (event_id % 97)::DOUBLE / 97 AS tcc, ((event_id * 7) % 90)::DOUBLE AS solar_zenith_angle, ((event_id * 13) % 31)::DOUBLE AS t2m_c, value * 4.0::DOUBLE AS ssrd_w_m2_lag_2h,
  value * 0.05::DOUBLE + (event_id % 11)::DOUBLE AS active_power_mw_clean FROM events)"""


#: A series of several years from ``orders``: ten sites, a reading each at a time of its own.
O = """o AS (SELECT o_orderkey, cast(o_custkey % 10 AS VARCHAR) AS location, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS timestamp, o_totalprice / 1000.0::DOUBLE AS ssrd_w_m2,
  (o_orderkey % 97)::DOUBLE / 97 AS tcc, ((o_orderkey * 7) % 90)::DOUBLE AS solar_zenith_angle, ((o_orderkey * 13) % 31)::DOUBLE AS t2m_c, o_totalprice / 2000.0::DOUBLE AS ssrd_w_m2_lag_2h,
  o_totalprice * 0.0001::DOUBLE + (o_orderkey % 11)::DOUBLE AS active_power_mw_clean FROM orders)"""  # noqa: E741


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SCHEMAS: dict[str, StructType] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up once, since each look is a job."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _s(spark: SparkSession, d: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return _t(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("location"), F.col("ts").alias("timestamp"), v.alias("kva"),
        F.when(F.col("event_type") != "error", v).alias("gap"), "event_type", "props",
        (v * 8.0).alias("ssrd_w_m2"), ((e % 97).cast("double") / 97).alias("tcc"), ((e * 7) % 90).cast("double").alias("solar_zenith_angle"),
        ((e * 13) % 31).cast("double").alias("t2m_c"), (v * 4.0).alias("ssrd_w_m2_lag_2h"), (v * 0.05 + (e % 11).cast("double")).alias("active_power_mw_clean"),
    )


def _o(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7919) % 86400)
    return _t(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("location"), (F.col("o_orderdate") + seconds).alias("timestamp"), (v / 1000.0).alias("ssrd_w_m2"),
        ((k % 97).cast("double") / 97).alias("tcc"), ((k * 7) % 90).cast("double").alias("solar_zenith_angle"), ((k * 13) % 31).cast("double").alias("t2m_c"),
        (v / 2000.0).alias("ssrd_w_m2_lag_2h"), (v * 0.0001 + (k % 11).cast("double")).alias("active_power_mw_clean"),
    )


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


HALF = "time_bucket(INTERVAL 30 MINUTE, timestamp)"
TS = lambda s: F.lit(s).cast("timestamp_ntz")


# Projections, casts, filters


@query(f"WITH {S} SELECT event_id, kva * 0.95::DOUBLE AS active_power_kw FROM s")
def power_scale(spark, d):
    return clean.scale_power(_s(spark, d), 0.95, "kva", "active_power_kw").select("event_id", "active_power_kw")


@query(f"WITH {S} SELECT event_id, gap FROM s WHERE gap IS NOT NULL")
def drop_invalid(spark, d):
    return _s(spark, d).na.drop(subset=["gap"]).select("event_id", "gap")


@query(f"WITH {S} SELECT event_id, try_cast(substr(location, 1, 1) || CASE WHEN event_type = 'error' THEN 'x' ELSE '' END AS DOUBLE) AS n FROM s")
def numeric_coerce(spark, d):
    s = _s(spark, d).withColumn("n", F.concat(F.substring("location", 1, 1), F.when(F.col("event_type") == "error", "x").otherwise("")))
    return clean.to_number(s, "n").select("event_id", "n")


@query(f"WITH {S} SELECT event_id, timestamp AS t FROM s WHERE event_type <> 'error'")
def timestamp_coerce(spark, d):
    s = _s(spark, d).withColumn("t", F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return clean.to_timestamp(s, "t").select("event_id", "t")


@query(f"WITH {S} SELECT event_id, (kva::FLOAT)::DOUBLE AS kva32 FROM s")
def float_downcast(spark, d):
    return clean.to_float(_s(spark, d), "kva").select("event_id", F.col("kva").cast("double").alias("kva32"))


@query("SELECT s_suppkey AS cell, s_acctbal AS weather_t2m, s_nationkey AS weather_u10 FROM supplier")
def rename_prefix(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("t2m"), F.col("s_nationkey").alias("u10"))
    return clean.rename_prefix(s, {"s_suppkey": "cell"}, "weather_", ["t2m", "u10"])


@query("SELECT c_custkey, c_acctbal, c_name FROM customer")
def select_present(spark, d):
    return clean.select_present(_t(spark, d, "customer"), ["c_custkey", "no_such", "c_acctbal", "c_name", "c_name"])


@query("SELECT c_acctbal, c_custkey, c_mktsegment, c_nationkey FROM customer")
def drop_columns(spark, d):
    return clean.without_columns(_t(spark, d, "customer"), ["c_name", "no_such"])


@query(f"WITH {S} SELECT event_id FROM s WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'")
def range_split(spark, d):
    return _s(spark, d).where(clean.between("timestamp", TS("2024-01-10"), TS("2024-01-20 12:00:00"))).select("event_id")


@query(f"WITH {S} SELECT event_id FROM s WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15'")
def halfopen_window(spark, d):
    return _s(spark, d).where(clean.half_open("timestamp", TS("2024-01-08"), 7)).select("event_id")


@query(f"WITH {S} SELECT event_id, timestamp <= TIMESTAMP '2024-01-15' AS in_train, timestamp >= TIMESTAMP '2024-01-18' AS in_val FROM s WHERE active_power_mw_clean IS NOT NULL AND (timestamp <= TIMESTAMP '2024-01-15' OR (timestamp >= TIMESTAMP '2024-01-18' AND timestamp <= TIMESTAMP '2024-01-25'))")
def train_val_split(spark, d):
    a, b = forecast.train_val(_s(spark, d), TS("2024-01-15"), TS("2024-01-18"), TS("2024-01-25"), "active_power_mw_clean")
    return sets.union_all(a.select("event_id", F.lit(True).alias("in_train"), F.lit(False).alias("in_val")), b.select("event_id", F.lit(False).alias("in_train"), F.lit(True).alias("in_val")))


@query(f"WITH {S}, n AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE location END AS location FROM s) SELECT * FROM n WHERE location IS NULL OR location NOT IN ('1', '2', '3')")
def notin_sites(spark, d):
    s = _s(spark, d).withColumn("location", F.when(F.col("event_type") != "error", F.col("location")))
    return s.where(clean.not_in("location", ["1", "2", "3"])).select("event_id", "location")


@query(f"WITH {S} SELECT event_id FROM s WHERE location IN ('1', '5', '7')")
def in_sites(spark, d):
    return _s(spark, d).where(F.col("location").isin("1", "5", "7")).select("event_id")


@query(f"WITH {O} SELECT o_orderkey FROM o WHERE hour(timestamp) BETWEEN 6 AND 19 AND month(timestamp) BETWEEN 5 AND 9 AND year(timestamp) = 1998")
def daylight_filter(spark, d):
    return _o(spark, d).where(clean.hours("timestamp", 6, 19) & clean.months("timestamp", 5, 9) & (F.year("timestamp") == 1998)).select("o_orderkey")


@query(f"WITH {S}, q AS (SELECT quantile_cont(ssrd_w_m2, 0.05) AS lo, quantile_cont(ssrd_w_m2, 0.95) AS hi FROM s) SELECT event_id, 'low' AS pool FROM s, q WHERE ssrd_w_m2 <= lo UNION ALL SELECT event_id, 'high' FROM s, q WHERE ssrd_w_m2 >= hi")
def analogue_pools(spark, d):
    lo, hi = clean.extreme_rows(_s(spark, d), "ssrd_w_m2", 0.05, 0.95)
    return sets.union_all(lo.select("event_id", F.lit("low").alias("pool")), hi.select("event_id", F.lit("high").alias("pool")))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# Aggregations


@query(f"WITH {S} SELECT location, {HALF} AS hh, round(coalesce(sum(gap * 0.95::DOUBLE), 0), 6) AS active_power_kw FROM s GROUP BY ALL")
def halfhour_sum(spark, d):
    s = clean.scale_power(_s(spark, d), 0.95, "gap", "active_power_kw").withColumn("n", timeseries.half_hour_number(F.col("timestamp")))
    return aggregate.sum_by(s, ["location", "n"], "active_power_kw").select("location", timeseries.half_hour_start(F.col("n")).alias("hh"), _r("active_power_kw"))


@query(f"WITH {S} SELECT location, count(*) AS total_points, count(gap) AS non_nan_points, count(gap)::DOUBLE / count(*) AS fraction_non_nan FROM s GROUP BY location")
def completeness_rank(spark, d):
    return aggregate.rank_completeness(_s(spark, d), "location", "gap")


@query(f"WITH {S} SELECT DISTINCT location FROM s")
def distinct_sites(spark, d):
    return aggregate.distinct_keys(_s(spark, d), "location")


@query(f"WITH {S} SELECT min(timestamp) AS first, max(timestamp) AS last, count(*) AS n FROM s")
def global_extent(spark, d):
    return aggregate.extent(_s(spark, d), "timestamp")


@query(f"WITH {S} SELECT count(*) FILTER (gap IS NULL) AS n_null, avg((gap IS NOT NULL)::INT::DOUBLE) AS fraction_present FROM s")
def null_fraction(spark, d):
    return aggregate.missing(_s(spark, d), "gap")


@query(f"WITH {S} SELECT count(*) AS n_rows, count(DISTINCT location) AS n_keys, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) FILTER (gap IS NULL) AS n_null FROM s")
def file_overview(spark, d):
    return aggregate.overview(_s(spark, d), "location", "timestamp", "gap")


_Q = ", ".join(f"round(quantile_cont({c}, 0.1), 6) AS {c}_lo, round(quantile_cont({c}, 0.9), 6) AS {c}_hi, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in WEATHER)


@query(f"WITH {S} SELECT location, {_Q} FROM s GROUP BY location")
def site_quantiles(spark, d):
    q = aggregate.site_quantiles(_s(spark, d), WEATHER)
    return q.select("location", *[_r(f"{c}_{k}") for c in WEATHER for k in ("lo", "hi", "min", "max")])


@query(f"WITH {O} SELECT location, cast(floor(quantile_cont(month(timestamp), 0.5)) AS INT) AS median_month FROM o GROUP BY location")
def median_month(spark, d):
    return aggregate.median_month(_o(spark, d))


_SC = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM s" for c in WEATHER)


@query(f"WITH {S} {_SC}")
def feature_scaler(spark, d):
    return aggregate.feature_scaler(_s(spark, d), WEATHER).select("feature", *[_r(c) for c in ("mean", "std", "min", "max")])


@query(f"WITH {S} SELECT event_id, round((ssrd_w_m2 - avg(ssrd_w_m2) OVER ()) / stddev_pop(ssrd_w_m2) OVER (), 6) AS ssrd_w_m2, round((tcc - avg(tcc) OVER ()) / stddev_pop(tcc) OVER (), 6) AS tcc FROM s")
def standardise(spark, d):
    s = _s(spark, d)
    z = scenario.standardise(s, aggregate.feature_scaler(s, WEATHER), ["ssrd_w_m2", "tcc"])
    return z.select("event_id", _r("ssrd_w_m2"), _r("tcc"))


@query(f"WITH {S}, b AS (SELECT avg(ssrd_w_m2) AS m, stddev_pop(ssrd_w_m2) AS sd, min(ssrd_w_m2) AS lo, max(ssrd_w_m2) AS hi FROM s) SELECT event_id, round(least(greatest((tcc * 6 - 3) * sd + m, lo), hi), 6) AS ssrd_w_m2 FROM s, b")
def inverse_clip(spark, d):
    s = _s(spark, d)
    z = s.withColumn("ssrd_w_m2", F.col("tcc") * 6 - 3)
    return scenario.unstandardise(z, aggregate.feature_scaler(s, WEATHER), ["ssrd_w_m2"]).select("event_id", _r("ssrd_w_m2"))


@query(f"WITH {S} SELECT location, round(avg(abs(kva - ssrd_w_m2 / 9)), 6) AS mae, round(sqrt(avg((kva - ssrd_w_m2 / 9) ** 2)), 6) AS rmse, round(100 * avg(CASE WHEN abs(kva) + abs(ssrd_w_m2 / 9) = 0 THEN 0 ELSE 2 * abs(kva - ssrd_w_m2 / 9) / (abs(kva) + abs(ssrd_w_m2 / 9)) END), 6) AS smape FROM s GROUP BY location")
def regression_metrics(spark, d):
    m = stats.error_metrics(F.col("kva"), F.col("ssrd_w_m2") / 9)
    return _s(spark, d).groupBy("location").agg(*[F.round(v, 6).alias(k) for k, v in m.items()])


_COR = "try_cast(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) AS DOUBLE)"


@query(f"WITH {S}, c AS (SELECT location, count(*) AS n, {_COR.format(x='ssrd_w_m2', y='active_power_mw_clean')} AS r FROM s GROUP BY location) SELECT location, (CASE WHEN n < 10 THEN 1 WHEN coalesce(r, -1) >= 0 THEN 1 ELSE -1 END)::INT AS orientation FROM c")
def orientation_all(spark, d):
    return _s(spark, d).groupBy("location").agg(stats.orientation_all(F.col("ssrd_w_m2"), F.col("active_power_mw_clean")).alias("orientation"))


@query(f"WITH {S}, m AS (SELECT location, CASE WHEN hour(timestamp) BETWEEN 11 AND 14 THEN tcc END AS x, CASE WHEN hour(timestamp) BETWEEN 11 AND 14 THEN t2m_c END AS y FROM s), c AS (SELECT location, count(x) AS n, {_COR.format(x='x', y='y')} AS r FROM m GROUP BY location) SELECT location, (CASE WHEN n < 5 THEN 1 WHEN coalesce(r, 1) < 0 THEN -1 ELSE 1 END)::INT AS orientation FROM c")
def orientation_midday(spark, d):
    mid = F.hour("timestamp").between(11, 14)
    x, y = F.when(mid, F.col("tcc")), F.when(mid, F.col("t2m_c"))
    return _s(spark, d).groupBy("location").agg(stats.orientation_negative(x, y, min_rows=5).alias("orientation"))


@query(f"WITH {S}, c AS (SELECT location, count(*) AS n, stddev_pop(kva) AS sd, regr_slope(active_power_mw_clean, kva) AS a, regr_intercept(active_power_mw_clean, kva) AS b FROM s GROUP BY location) SELECT location, round(CASE WHEN n >= 2 AND sd >= 1e-6 THEN a ELSE 1 END, 6) AS slope, round(CASE WHEN n >= 2 AND sd >= 1e-6 THEN b ELSE 0 END, 6) AS intercept FROM c")
def calibration_plain(spark, d):
    a, b = stats.calibration_plain(F.col("active_power_mw_clean"), F.col("kva"))
    return _s(spark, d).groupBy("location").agg(F.round(a, 6).alias("slope"), F.round(b, 6).alias("intercept"))


@query(f"WITH {S}, g AS (SELECT *, count(*) OVER (PARTITION BY location) AS n, quantile_cont(active_power_mw_clean, 0.01) OVER (PARTITION BY location) AS lo, quantile_cont(active_power_mw_clean, 0.99) OVER (PARTITION BY location) AS hi FROM s WHERE gap IS NOT NULL), c AS (SELECT location, any_value(n) AS n, regr_slope(active_power_mw_clean, gap) AS a, regr_intercept(active_power_mw_clean, gap) AS b FROM g WHERE active_power_mw_clean BETWEEN lo AND hi GROUP BY location) SELECT location, round(CASE WHEN n < 10 OR a IS NULL OR isnan(a) THEN 1 ELSE a END, 6) AS slope, round(CASE WHEN n < 10 OR a IS NULL OR isnan(a) THEN 0 ELSE b END, 6) AS intercept FROM c")
def calibration_trimmed(spark, d):
    return capacity.calibration(_s(spark, d), "active_power_mw_clean", "gap").select("location", _r("slope"), _r("intercept"))


@query(f"WITH {S} SELECT event_id, round(coalesce(gap * 1.0::DOUBLE, 0) + tcc * (-1.0)::DOUBLE, 6) AS score FROM s")
def solar_score(spark, d):
    return aggregate.solar_score(_s(spark, d), {"gap": 1.0, "tcc": -1.0, "no_such": 3.0}).select("event_id", _r("score"))


@query(f"WITH {S}, q AS (SELECT location, quantile_cont(gap, 0.2) AS lo, quantile_cont(gap, 0.8) AS hi FROM s GROUP BY location) SELECT event_id, coalesce(gap <= lo, false) AS in_low, coalesce(gap >= hi, false) AS in_high FROM s JOIN q USING (location)")
def score_pools(spark, d):
    return aggregate.score_pools(_s(spark, d), "gap", ["location"]).select("event_id", "in_low", "in_high")


_OVERLAP = "SELECT a.label, round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS overlap FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label"


@query(_OVERLAP)
def head_overlap(spark, d):
    return aggregate.head_overlap(_t(spark, d, "embeddings"), "label", "embedding", "vec_id").where("overlap IS NOT NULL").select("label", _r("overlap", 5))


@query(_OVERLAP)
def head_overlap_all(spark, d):
    """Another name of ``head_overlap``."""
    return head_overlap(spark, d)


# Time series


@query(f"WITH {S} SELECT event_id, row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 AS time_idx FROM s")
def time_index_cumcount(spark, d):
    return timeseries.index_by_count(_s(spark, d)).select("event_id", "time_idx")


@query(f"WITH {S} SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY timestamp, event_id) - 1 AS time_idx FROM s")
def time_index_spans(spark, d):
    """Four hot keys, each cut into eight spans of time: a task numbers one span."""
    return timeseries.index_by_count(_s(spark, d), "event_type", spans=8, ties=["event_id"]).select("event_id", "time_idx")


@query(f"WITH {S} SELECT event_id, trunc(date_diff('microsecond', TIMESTAMP '2024-01-10 00:10:00', timestamp)::DOUBLE / 1800000000)::BIGINT AS time_idx FROM s")
def time_index_trunc(spark, d):
    return timeseries.index_from_origin(_s(spark, d), TS("2024-01-10 00:10:00"), truncate=True).select("event_id", "time_idx")


@query(f"WITH {S} SELECT event_id, floor(date_diff('microsecond', TIMESTAMP '2024-01-10 00:10:00', timestamp)::DOUBLE / 1800000000)::BIGINT AS time_idx FROM s")
def time_index_floor(spark, d):
    return timeseries.index_from_origin(_s(spark, d), TS("2024-01-10 00:10:00")).select("event_id", "time_idx")


@query(f"WITH {S} SELECT event_id, floor(date_diff('microsecond', (SELECT min(timestamp) FROM s), timestamp)::DOUBLE / 1800000000)::BIGINT AS time_idx FROM s")
def time_index_global_min(spark, d):
    return timeseries.index_from_first(_s(spark, d)).select("event_id", "time_idx")


@query(f"WITH {S} SELECT event_id, last_value(gap IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM s")
def ffill_power(spark, d):
    return timeseries.forward_fill(_s(spark, d), "gap", out="filled").select("event_id", "filled")


@query(f"WITH {S} SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN kva END AS v FROM s)")
def ffill_spans(spark, d):
    """The same for fills: what is open at the start of a span takes the last value of the spans before."""
    s = _s(spark, d).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("kva")))
    return timeseries.forward_fill(s, "v", "event_type", out="filled", spans=8, ties=["event_id"]).select("event_id", "filled")


@query(f"WITH {S} SELECT event_id FROM s QUALIFY (row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1) % 5 = 0")
def every_nth(spark, d):
    return timeseries.every_nth(_s(spark, d), 5).select("event_id")


@query(f"WITH {S}, i AS (SELECT event_id, row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 AS t FROM s), m AS (SELECT max(t) AS m FROM i) SELECT event_id, CASE WHEN t <= floor(m * 0.6::DOUBLE) THEN 'train' WHEN t <= floor(m * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM i, m")
def fraction_split(spark, d):
    return timeseries.split_by_fraction(timeseries.index_by_count(_s(spark, d)), 0.6, 0.9).select("event_id", "split")


@query(f"WITH {S}, i AS (SELECT location, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', timestamp)::DOUBLE / 1800000000)::BIGINT AS t FROM s), f AS (SELECT location, min(t) AS t FROM i GROUP BY location) SELECT max(t) AS boundary FROM f")
def split_boundary(spark, d):
    return timeseries.latest_first_index(timeseries.index_from_origin(_s(spark, d), TS("2024-01-01")))


@query(f"WITH {S}, i AS (SELECT timestamp, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', timestamp)::DOUBLE / 1800000000)::BIGINT AS t FROM s) SELECT coalesce(min(t) FILTER (timestamp >= TIMESTAMP '2024-01-12'), min(t)) AS boundary FROM i")
def prediction_start(spark, d):
    return timeseries.earliest_index(timeseries.index_from_origin(_s(spark, d), TS("2024-01-01")), start=F.col("timestamp") >= TS("2024-01-12"))


@query(f"WITH {S}, i AS (SELECT event_id, location, row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY location) AS n FROM s), w AS (SELECT *, unnest(range(0, n - 30, 20)) AS window_start FROM i) SELECT event_id, window_start, i - window_start AS place FROM w WHERE i >= window_start AND i < window_start + 30")
def sliding_windows(spark, d):
    return timeseries.sliding_windows(_s(spark, d), 30, 20).select("event_id", "window_start", "place")


@query(f"WITH {S}, w AS (SELECT location, timestamp, list(round(kva, 4)) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS a, list(round(kva, 4)) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM s) SELECT location, timestamp, array_to_string(a, ',') AS encoder, array_to_string(b, ',') AS decoder FROM w WHERE len(a) = 8 AND len(b) = 4")
def sequence_windows(spark, d):
    q = timeseries.sequences(_s(spark, d).withColumn("kva", F.round("kva", 4)), "kva", 8, 4)
    return q.select("location", "timestamp", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("encoder", "decoder")])


@query(f"WITH {S}, p AS (SELECT event_id, unnest([kva, kva * 2, kva * 3]) AS y_hat, unnest([1, 2, 3]) AS horizon_step FROM s) SELECT event_id, horizon_step::INT AS horizon_step, y_hat FROM p")
def horizon_explode(spark, d):
    p = _s(spark, d).select("event_id", F.array(F.col("kva"), F.col("kva") * 2, F.col("kva") * 3).alias("y_hat"))
    return timeseries.explode_horizon(p).select("event_id", "horizon_step", "y_hat")


@query(f"WITH {S} SELECT event_id FROM s WHERE timestamp BETWEEN TIMESTAMP '2024-01-15' - INTERVAL 240 MINUTE AND TIMESTAMP '2024-01-20' + INTERVAL 90 MINUTE")
def warmup_window(spark, d):
    return _s(spark, d).where(timeseries.warm_up("timestamp", TS("2024-01-15"), TS("2024-01-20"), 8, 4)).select("event_id")


_YEARLY = "y AS (SELECT o_custkey AS location, year(o_orderdate) AS year, avg(o_totalprice) AS mean FROM orders GROUP BY ALL)"
_GROWN = "g AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(mean) OVER w END AS p FROM y WINDOW w AS (PARTITION BY location ORDER BY year)), r AS (SELECT location, year::INT AS year, CASE WHEN p > 0 AND mean <> 0 THEN mean - p END AS growth_mw, CASE WHEN p > 0 AND mean <> 0 THEN (mean - p) / p * 100 END AS growth_pct FROM g)"


def _yearly(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("location"), F.year("o_orderdate").alias("year"))
    return timeseries.growth(o.agg(F.avg("o_totalprice").alias("mean")), digits=None)


@query(f"WITH {_YEARLY}, {_GROWN} SELECT location, year, round(growth_mw, 6) AS growth_mw, round(growth_pct, 4) AS growth_pct FROM r")
def yoy_growth(spark, d):
    return _yearly(spark, d).select("location", "year", _r("growth_mw"), _r("growth_pct", 4))


@query(f"WITH {_YEARLY}, {_GROWN} SELECT location, year, round(growth_mw, 6) AS growth_mw FROM r WHERE growth_mw IS NOT NULL ORDER BY growth_mw DESC, location LIMIT 10")
def top_growth(spark, d):
    return _yearly(spark, d).where("growth_mw IS NOT NULL").orderBy(F.desc("growth_mw"), "location").limit(10).select("location", "year", _r("growth_mw"))


@query(f"WITH {_YEARLY}, {_GROWN} SELECT year, count(*) AS n_sites, round(avg(growth_mw), 1) AS mean_mw, round(avg(growth_pct), 1) AS mean_pct, round(median(growth_pct), 1) AS median_pct, count(*) FILTER (growth_mw > 0) AS n_positive FROM r WHERE growth_mw IS NOT NULL GROUP BY year")
def fleet_summary(spark, d):
    return aggregate.fleet_summary(_yearly(spark, d)).select("year", "n_sites", _r("mean_mw", 1), _r("mean_pct", 1), _r("median_pct", 1), "n_positive")


@query("SELECT location, year::INT AS year, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS n_samples FROM (SELECT o_custkey AS location, year(o_orderdate) AS year, o_totalprice AS v FROM orders) GROUP BY ALL HAVING count(*) >= 3")
def site_year_gate(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("location"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("capacity"))
    return aggregate.site_year(o, min_windows=3).select("location", "year", _r("mean"), _r("p90"), "n_samples")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders) SELECT year, unnest(CASE WHEN year = (SELECT min(year) FROM y) THEN [1990, 1991] ELSE [year - 2, year - 1] END)::INT AS analogue_year FROM y")
def analogue_year_choice(spark, d):
    return capacity.analogue_year_table(_t(spark, d, "orders"), "o_orderdate", (1990, 1991))


# Joins, sets, text


@query("SELECT s_suppkey, n_name, round(s_acctbal, 2) AS weather_t2m FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def grid_map_join(spark, d):
    n = _t(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 0.25).alias("era5_lat"), F.lit(1.5).alias("era5_lon"))
    w = _t(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("weather_t2m"), (F.col("s_nationkey") * 0.25).cast("float").alias("era5_lat"), F.lit(1.5).cast("float").alias("era5_lon"))
    return joins.weather_to_sites(w, n).select("s_suppkey", "n_name", "weather_t2m")


@query(f"WITH {S} SELECT a.location, a.timestamp, a.kva, b.t2m_c AS weather_t2m FROM s a JOIN s b ON a.location = b.location AND a.timestamp = b.timestamp")
def power_weather_join(spark, d):
    s = _s(spark, d)
    return joins.power_to_weather(s.select("location", "timestamp", "kva"), s.select("location", "timestamp", F.col("t2m_c").alias("weather_t2m")))


@query(f"WITH {S}, m AS (SELECT DISTINCT location, location::INT % 5 AS cell FROM s), w AS (SELECT timestamp, location::INT % 5 AS cell, t2m_c AS weather_t2m FROM s) SELECT s.location, s.timestamp, s.kva, weather_t2m FROM s JOIN m USING (location) JOIN w ON w.cell = m.cell AND w.timestamp = s.timestamp")
def merged_table(spark, d):
    s = _s(spark, d)
    cell = F.col("location").cast("int") % 5
    at = lambda kind: {"era5_lat": (50 + cell * 0.25).cast(kind), "era5_lon": (cell * 0.25 - 1).cast(kind)}
    mapping = s.select("location").distinct().withColumns(at("double"))
    weather = s.withColumns(at("float")).select("timestamp", "era5_lat", "era5_lon", F.col("t2m_c").alias("weather_t2m"))
    return merge.combine(s.select("location", "timestamp", "kva"), mapping, weather).select("location", "timestamp", "kva", "weather_t2m")


@query("SELECT c_custkey, c_nationkey, n_regionkey::DOUBLE AS longitude, n_nationkey::DOUBLE AS latitude FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def attach_left(spark, d):
    n = _t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("double").alias("longitude"), F.col("n_nationkey").cast("double").alias("latitude"))
    return joins.attach_coordinates(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), n.unionAll(n), "c_nationkey")


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), ' '), lambda t: t <> ''))"
_MATCH = f"""WITH l AS (SELECT p_name AS location_name FROM part UNION SELECT n_name FROM nation), g AS (SELECT p_partkey AS pos, p_name || ' ' || p_type AS geo_name, p_size::DOUBLE AS longitude, p_retailprice AS latitude FROM part),
lt AS (SELECT location_name, {_TOK.format(x='location_name')} AS a FROM l), gt AS (SELECT *, {_TOK.format(x='geo_name')} AS b FROM g),
p AS (SELECT location_name, pos, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS score FROM (SELECT location_name, len(a) AS n, unnest(a) AS t FROM lt) JOIN (SELECT pos, len(b) AS m, unnest(b) AS t FROM gt) USING (t) GROUP BY ALL),
m AS (SELECT location_name, arg_max(pos, (score, -pos)) AS pos, max(score) AS score FROM p GROUP BY location_name),
r AS (SELECT location_name, geo_name AS matched_geo_name, round(score, 9) AS score, longitude, latitude FROM m JOIN g USING (pos) WHERE m.score >= 0.45)"""
_MATCHED, _UNMATCHED = f"{_MATCH} SELECT * FROM r", f"{_MATCH} SELECT location_name FROM l WHERE location_name NOT IN (SELECT location_name FROM r)"


def _names(spark, d):
    p = _t(spark, d, "part")
    right = p.select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_type").alias("geo_name"), F.col("p_size").cast("double").alias("longitude"), F.col("p_retailprice").alias("latitude"))
    return p.select(F.col("p_name").alias("location_name")).unionAll(_t(spark, d, "nation").select("n_name")), right


@query(_MATCHED)
def fuzzy_match(spark, d):
    return joins.matched(joins.best_match(*_names(spark, d), 0.45)).select("location_name", "matched_geo_name", _r("score", 9), "longitude", "latitude")


@query(_UNMATCHED)
def fuzzy_unmatched(spark, d):
    return joins.unmatched(joins.best_match(*_names(spark, d), 0.45))


@query(_MATCHED)
def fuzzy_match_all(spark, d):
    """Another name of ``fuzzy_match``."""
    return fuzzy_match(spark, d)


@query(_UNMATCHED)
def fuzzy_unmatched_all(spark, d):
    return fuzzy_unmatched(spark, d)


@query(f"""{_MATCH}, a AS (SELECT p_name AS location_name, p_size % 5 AS hh, sum(p_retailprice) AS kw FROM part GROUP BY ALL)
SELECT a.location_name, hh::INT AS hh, round(kw, 6) AS active_power_kw, longitude, latitude FROM a LEFT JOIN r USING (location_name)""")
def located_power(spark, d):
    names, geo = _names(spark, d)
    agg = _t(spark, d, "part").groupBy(F.col("p_name").alias("tx_id"), (F.col("p_size") % 5).alias("hh")).agg(F.sum("p_retailprice").alias("active_power_kw"))
    located, _, _ = ingest.locate(agg, geo, 0.45)
    return located.select("location_name", F.col("hh").cast("int"), _r("active_power_kw"), "longitude", "latitude")


@query(f"WITH {S} SELECT event_id FROM s WHERE location IN (SELECT location FROM s WHERE event_type = 'error')")
def semi_trained(spark, d):
    s = _s(spark, d)
    return joins.trained_only(s, s.where("event_type = 'error'")).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unseen(spark, d):
    return joins.unseen_only(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query(f"WITH {S}, l AS (SELECT DISTINCT location FROM s), t AS (SELECT location AS model_location, row_number() OVER (ORDER BY location) - 1 AS i, count(*) OVER () AS n FROM l WHERE location::INT % 3 <> 0) SELECT location, coalesce(own.model_location, p.model_location) AS model_location FROM l LEFT JOIN t own ON location = own.model_location JOIN t p ON p.i = ('0x' || substr(md5(location), 1, 8))::BIGINT % p.n")
def proxy_unseen(spark, d):
    s = _s(spark, d).select("location").distinct()
    return joins.proxy_unseen(s, s.where(F.col("location").cast("int") % 3 != 0))


@query(f"WITH {S}, t AS (SELECT location, hour(timestamp) AS h, timestamp, event_id FROM s), f AS (SELECT location, h, arg_min(timestamp, event_id) AS t0 FROM t GROUP BY ALL) SELECT event_id, t0 FROM (SELECT event_id, location, (hour(timestamp) + 1) % 24 AS h FROM s) r JOIN f USING (location, h)")
def lookup_first(spark, d):
    s = _s(spark, d)
    t = s.select("location", F.hour("timestamp").alias("h"), F.col("timestamp").alias("t0"), "event_id")
    r = s.select(F.col("event_id").alias("e"), "location", ((F.hour("timestamp") + 1) % 24).alias("h"))
    return joins.lookup_first(r, t, ["location", "h"], "t0", "event_id").select(F.col("e").alias("event_id"), "t0")


@query(f"WITH {S}, t AS (SELECT location, hour(timestamp) AS h, timestamp, event_id FROM s), f AS (SELECT location, h, arg_max(timestamp, event_id) AS t0 FROM t GROUP BY ALL) SELECT event_id, t0 FROM (SELECT event_id, location, (hour(timestamp) + 1) % 24 AS h FROM s) r JOIN f USING (location, h)")
def lookup_last(spark, d):
    s = _s(spark, d)
    t = s.select("location", F.hour("timestamp").alias("h"), F.col("timestamp").alias("t0"), "event_id")
    r = s.select(F.col("event_id").alias("e"), "location", ((F.hour("timestamp") + 1) % 24).alias("h"))
    return joins.lookup_last(r, t, ["location", "h"], "t0", "event_id").select(F.col("e").alias("event_id"), "t0")


@query(f"WITH {S} SELECT event_id, dense_rank() OVER (ORDER BY location) - 1 AS label_id FROM s")
def label_index(spark, d):
    return joins.label_ids(_s(spark, d), "location").select("event_id", "label_id")


@query(f"WITH {S}, f AS (SELECT hour(timestamp) AS h, arg_min(ssrd_w_m2, event_id) AS ssrd_w_m2, arg_min(tcc, event_id) AS tcc FROM s WHERE tcc > 0.9 GROUP BY 1), a AS (SELECT arg_min(ssrd_w_m2, event_id) AS sa, arg_min(tcc, event_id) AS ta FROM s WHERE tcc > 0.9) SELECT event_id, coalesce(f.ssrd_w_m2, sa) AS ssrd_w_m2, coalesce(f.tcc, ta) AS tcc FROM s LEFT JOIN f ON hour(s.timestamp) = f.h CROSS JOIN a")
def hour_analogue_join(spark, d):
    s = _s(spark, d)
    return joins.hour_analogue(s, s.where("tcc > 0.9"), ["ssrd_w_m2", "tcc"], pick=F.col("event_id")).select("event_id", "ssrd_w_m2", "tcc")


@query("SELECT s_suppkey AS k, s_name AS name, NULL::INT AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_missing(spark, d):
    return sets.union_all(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")))


@query("SELECT DISTINCT p_name, p_size % 5 AS m FROM part")
def dedupe_full(spark, d):
    return sets.distinct_rows(_t(spark, d, "part").select("p_name", (F.col("p_size") % 5).alias("m")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, d):
    return sets.first_per_key(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH t AS (SELECT p_partkey, {_TOK.format(x='p_name')} AS a, {_TOK.format(x='p_type')} AS b FROM part) SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS score FROM t")
def token_jaccard(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(text.jaccard(F.col("p_name"), F.col("p_type")), 9).alias("score"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '   ' || p_brand || ' '), '\\s+', ' ', 'g')) AS cleaned FROM part")
def string_cleanup(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.clean(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))).alias("cleaned"))


_SOME = "k AS (SELECT location FROM (SELECT DISTINCT location FROM s) ORDER BY md5('42:' || location), location LIMIT {n})"


@query(f"WITH {S}, {_SOME.format(n=7)} SELECT location FROM k")
def sample_sites(spark, d):
    return sampling.sample_keys(_s(spark, d), "location", 7)


@query(f"WITH {S} SELECT event_id FROM s ORDER BY md5('42:' || event_id), event_id LIMIT 100")
def sample_rows(spark, d):
    return sampling.sample_rows(_s(spark, d), 100, ["event_id"]).select("event_id")


@query(f"WITH {S}, {_SOME.format(n=10)}, n AS (SELECT location, timestamp, kva, row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 AS i FROM s JOIN k USING (location) WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15') SELECT location, timestamp, kva FROM n WHERE i % 3 = 0")
def plot_lines(spark, d):
    return reports.plot_lines(_s(spark, d), "kva", sites=10, start=TS("2024-01-08"), days=7, every=3)


@query(f"WITH {S} SELECT count(*) AS n_rows, count(DISTINCT location) AS n_keys, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) FILTER (gap IS NULL) AS n_null, avg((gap IS NOT NULL)::INT::DOUBLE) AS fraction_present FROM s")
def sanity_report(spark, d):
    return reports.sanity(_s(spark, d), "location", "timestamp", "gap")


# Scenarios and estimators


@query(f"WITH {S} SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN greatest(tcc * 30 - t2m_c, 0) ELSE greatest(t2m_c - tcc * 30, 0) END, 6) AS delta FROM s")
def oriented_delta(spark, d):
    """Both orientations: where output falls with the sun the difference is turned."""
    delta = scenario.signed_delta(F.col("t2m_c"), F.col("tcc") * 30, F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return _s(spark, d).select("event_id", F.round(delta, 6).alias("delta"))


@query(f"WITH {S} SELECT event_id, gap, props FROM s WHERE gap IS NOT NULL AND (event_id % 5 <> 0 OR event_id % 7 <> 0)")
def drop_any_and_all(spark, d):
    """Rows without any of two values go, and rows without one of all."""
    e = F.col("event_id")
    s = _s(spark, d).withColumns({"a": F.when(e % 5 != 0, e), "b": F.when(e % 7 != 0, e)}).na.drop("all", subset=["a", "b"])
    return s.select("event_id", "gap", "props").na.drop("any")


def _mods_sql(prefix: str = "") -> str:
    out = []
    for c in WEATHER:
        lo = f"least(greatest(quantile_cont({c}, 0.1) * 0.9::DOUBLE, min({c})), max({c}))"
        hi = f"least(greatest(quantile_cont({c}, 0.9) * 1.1::DOUBLE, min({c})), max({c}))"
        lo, hi = (hi, lo) if scenario.inverted(c) else (lo, hi)
        out += [f"{lo} AS {c}_low_sun", f"{hi} AS {c}_high_sun"]
    return f"m AS (SELECT location, {', '.join(out)} FROM s GROUP BY location)"


_NAMES = [f"{c}_{k}_sun" for c in WEATHER for k in ("low", "high")]


@query(f"WITH {S}, {_mods_sql()} SELECT location, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM m")
def coherent_mods(spark, d):
    return scenario.coherent_mods(_s(spark, d), WEATHER).select("location", *[_r(c) for c in _NAMES])


def _day(side: str) -> str:
    return ", ".join(f"CASE WHEN hour(timestamp) BETWEEN 6 AND 19 THEN {c}_{side}_sun ELSE {c} END AS {c}" for c in WEATHER)


@query(f"WITH {S}, {_mods_sql()}, h AS (SELECT event_id, {_day('high')} FROM s JOIN m USING (location)) SELECT event_id, {', '.join(f'round({c}, 6) AS {c}' for c in WEATHER)} FROM h")
def apply_scenario(spark, d):
    s = _s(spark, d)
    _, high = scenario.scenario_pair(s, scenario.coherent_mods(s, WEATHER), WEATHER)
    return high.select("event_id", *[_r(c) for c in WEATHER])


@query(f"WITH {S} SELECT event_id, CASE WHEN hour(timestamp) BETWEEN 6 AND 19 THEN 700.0::DOUBLE ELSE ssrd_w_m2 END AS ssrd_w_m2, CASE WHEN hour(timestamp) BETWEEN 6 AND 19 THEN 700.0::DOUBLE ELSE ssrd_w_m2_lag_2h END AS ssrd_w_m2_lag_2h, tcc FROM s")
def sibling_overwrite(spark, d):
    return scenario.apply_constants(_s(spark, d), {"ssrd_w_m2": 700.0, "no_such": 1.0}, siblings=True).select("event_id", "ssrd_w_m2", "ssrd_w_m2_lag_2h", "tcc")


_SIDES = "h AS (SELECT event_id, {Y} AS y FROM (SELECT event_id, ssrd_w_m2_lag_2h, {high} FROM j)), l AS (SELECT event_id, {Y} AS y FROM (SELECT event_id, ssrd_w_m2_lag_2h, {low} FROM j))".format(Y=Y, high=_day("high"), low=_day("low"))


@query(f"WITH {S}, {_mods_sql()}, j AS (SELECT * FROM s JOIN m USING (location)), {_SIDES} SELECT location, timestamp, 1::INT AS horizon_step, round(h.y, 6) AS y_hat_max, round(l.y, 6) AS y_hat_min FROM s JOIN h USING (event_id) JOIN l USING (event_id)")
def high_low_join(spark, d):
    s = _s(spark, d)
    low, high = scenario.scenario_pair(s, scenario.coherent_mods(s, WEATHER), WEATHER)
    p = joins.high_low(forecast.predict(high, MODEL), forecast.predict(low, MODEL))
    return p.select("location", "timestamp", "horizon_step", _r("y_hat_max"), _r("y_hat_min"))


@query(f"""WITH {S}, {_mods_sql()}, j AS (SELECT * FROM s JOIN m USING (location)), {_SIDES},
x AS (SELECT location, greatest(h.y - l.y, 0) AS delta FROM s JOIN h USING (event_id) JOIN l USING (event_id))
SELECT location, round(avg(delta), 6) AS mean_impact_mw, round(quantile_cont(delta, 0.95), 6) AS p95_impact_mw FROM x GROUP BY location""")
def brute_capacity(spark, d):
    return capacity.brute_force(_s(spark, d), MODEL, WEATHER).select("location", _r("mean_impact_mw"), _r("p95_impact_mw"))


#: Draw i of a pool with seed q (SQL): the pool's row at the hash of site and draw.
_DRAW = "SELECT location, i AS draw, ssrd_w_m2 AS {k}_ssrd, tcc AS {k}_tcc FROM (SELECT location, i, ('0x' || substr(md5('{q}:' || location || ':' || i), 1, 8))::BIGINT % n AS place FROM (SELECT location, count(*) AS n FROM pool WHERE {k} GROUP BY location), range(1, 21) r(i)) JOIN (SELECT *, row_number() OVER (PARTITION BY location ORDER BY candidate) - 1 AS place FROM pool WHERE {k}) USING (location, place)"
_LINEAR = "(1.0::DOUBLE + {a} * 0.01::DOUBLE + {b} * (-0.5)::DOUBLE + solar_zenith_angle * (-0.02)::DOUBLE + t2m_c * 0.1::DOUBLE + {c} * 0.005::DOUBLE)"


def _drawn(k: str) -> str:
    day = lambda x, own: f"(CASE WHEN hour(timestamp) BETWEEN 6 AND 19 THEN {x} ELSE {own} END)"
    return _LINEAR.format(a=day(f"{k}_ssrd", "ssrd_w_m2"), b=day(f"{k}_tcc", "tcc"), c=day(f"{k}_ssrd", "ssrd_w_m2_lag_2h"))


@query(f"""WITH {O}, site AS (SELECT location, cast(floor(quantile_cont(month(timestamp), 0.5)) AS INT) AS mm, count(*) FILTER (su) AS n, {_COR.format(x='x', y='y')} AS r
  FROM (SELECT *, CASE WHEN su THEN ssrd_w_m2 END AS x, CASE WHEN su THEN active_power_mw_clean END AS y FROM (SELECT *, month(timestamp) BETWEEN 5 AND 9 AND hour(timestamp) BETWEEN 11 AND 14 AS su FROM o)) GROUP BY location),
noon AS (SELECT o.*, row_number() OVER (PARTITION BY location ORDER BY md5('42:' || location || ':' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')), timestamp) - 1 AS candidate FROM o JOIN site USING (location) WHERE hour(timestamp) = 12 AND month(timestamp) = mm),
c AS (SELECT location, candidate, ssrd_w_m2, tcc, ssrd_w_m2 * 1.0::DOUBLE + tcc * (-1.0)::DOUBLE AS score FROM noon WHERE candidate < 64),
q AS (SELECT location, quantile_cont(score, 0.2) AS lo, quantile_cont(score, 0.8) AS hi FROM c GROUP BY location), pool AS (SELECT c.*, score <= lo AS low, score >= hi AS high FROM c JOIN q USING (location)),
dl AS ({_DRAW.format(k='low', q=42)}), dh AS ({_DRAW.format(k='high', q=43)}),
y AS (SELECT location, n >= 20 AND r < 0 AS turned, {_drawn('high')} AS yh, {_drawn('low')} AS yl FROM o JOIN dl USING (location) JOIN dh USING (location, draw) JOIN site USING (location)),
x AS (SELECT location, greatest(CASE WHEN turned THEN (1.5::DOUBLE * yl + 0.25::DOUBLE) - (1.5::DOUBLE * yh + 0.25::DOUBLE) ELSE (1.5::DOUBLE * yh + 0.25::DOUBLE) - (1.5::DOUBLE * yl + 0.25::DOUBLE) END, 0) AS delta FROM y)
SELECT location, round(avg(delta), 6) AS mean_impact_mw, round(quantile_cont(delta, 0.95), 6) AS p95_impact_mw FROM x GROUP BY location""")
def manifold_capacity(spark, d):
    w = {"ssrd_w_m2": 1.0, "tcc": -1.0}
    m = capacity.on_manifold(_o(spark, d), MODEL, w, target="active_power_mw_clean", primary="ssrd_w_m2", slope=1.5, intercept=0.25)
    return m.select("location", _r("mean_impact_mw"), _r("p95_impact_mw"))


_MOMENTS = """m AS (SELECT location, month(timestamp)::INT AS month, hour(timestamp)::INT AS hour, count(*) AS n, avg(ssrd_w_m2) AS ma, min(ssrd_w_m2) AS la, max(ssrd_w_m2) AS ha, avg(tcc) AS mb, min(tcc) AS lb, max(tcc) AS hb,
  covar_pop(ssrd_w_m2, ssrd_w_m2) AS caa, covar_pop(ssrd_w_m2, tcc) AS cab, covar_pop(tcc, tcc) AS cbb FROM o GROUP BY ALL)"""


#: The mean of a few prices often lies halfway between two roundings, where the last bit of the sum would decide.
_NUDGE = 1e-8


@query(f"WITH {O}, {_MOMENTS} SELECT location, month, hour, n, round(ma + {_NUDGE}::DOUBLE, 6) AS mean_ssrd_w_m2, round(mb, 6) AS mean_tcc, round(la, 6) AS min_ssrd_w_m2, round(ha, 6) AS max_ssrd_w_m2, round(caa, 4) AS cov_ssrd_w_m2_ssrd_w_m2, round(cab, 4) AS cov_ssrd_w_m2_tcc, round(cbb, 4) AS cov_tcc_tcc FROM m")
def weather_moments(spark, d):
    m = generate.conditional_moments(generate.calendar_keys(_o(spark, d)), ["ssrd_w_m2", "tcc"])
    m = m.withColumn("mean_ssrd_w_m2", F.col("mean_ssrd_w_m2") + F.lit(_NUDGE))
    return m.select("location", "month", "hour", "n", *[_r(f"{k}_{c}") for k, c in (("mean", "ssrd_w_m2"), ("mean", "tcc"), ("min", "ssrd_w_m2"), ("max", "ssrd_w_m2"))], *[_r(f"cov_{a}_{b}", 4) for a, b in (("ssrd_w_m2", "ssrd_w_m2"), ("ssrd_w_m2", "tcc"), ("tcc", "tcc"))])


_UNIT = "(('0x' || substr(md5('43:{k}:' || location || ':' || month || ':' || hour || ':' || g::DOUBLE || ':' || draw), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(f"""WITH {O}, {_MOMENTS}, f AS (SELECT *, CASE WHEN caa > 0 THEN sqrt(caa) ELSE 0 END AS l00 FROM m), g AS (SELECT *, CASE WHEN l00 > 0 THEN cab / l00 ELSE 0 END AS l10 FROM f),
h AS (SELECT *, CASE WHEN cbb - l10 ** 2 > cbb * 1e-9::DOUBLE THEN sqrt(cbb - l10 ** 2) ELSE 0 END AS l11, (round(ma) + 5)::BIGINT AS g FROM g), r AS (SELECT *, unnest(range(1, 9))::INT AS draw FROM h),
z AS (SELECT *, sqrt(-2 * ln({_UNIT.format(k=1)})) * cos(2 * pi() * {_UNIT.format(k=2)}) AS zb, CASE WHEN l00 > 0 THEN (g - ma) / l00 ELSE 0 END AS za FROM r)
SELECT location, month, hour, draw, g::DOUBLE AS ssrd_w_m2, round(least(greatest(mb + l10 * za + l11 * zb, lb), hb), 5) AS tcc FROM z""")
def weather_draws(spark, d):
    """Eight generated cloud values for each site, month and hour, given an irradiance 5 above its mean."""
    m = generate.conditional_moments(generate.calendar_keys(_o(spark, d)), ["ssrd_w_m2", "tcc"])
    asked = m.select("location", "month", "hour", (F.round("mean_ssrd_w_m2") + 5).cast("long").alias("ssrd_w_m2"))
    return generate.conditional_draws(m, asked, ["ssrd_w_m2", "tcc"], 8, given=["ssrd_w_m2"]).withColumn("tcc", F.round("tcc", 5))


_YEARS = (1998, 1999, 2000)
_AT = ", ".join(f"max({c}) FILTER (year = {y}) AS capacity_{y}_{c}" for y in _YEARS for c in ("mean", "p90"))
_SAMPLES = ", ".join(f"coalesce(max(n_samples) FILTER (year = {y}), 0) AS n_samples_{y}" for y in _YEARS)
_GAINS = ", ".join(f"round_even(max(g{u}) FILTER (year = {y}), {r}) AS growth_{y - 1}_{y}_{u}" for y in _YEARS[1:] for u, r in (("mw", 4), ("pct", 2)))
_FEATURES = "{'ssrd_w_m2': ssrd_w_m2, 'tcc': tcc, 'solar_zenith_angle': solar_zenith_angle, 't2m_c': t2m_c}"


def _analogue_sql(k: str) -> str:
    get = lambda c: f"struct_extract(coalesce({k}, any_{k}), '{c}')"
    z = _LINEAR.format(a=get("ssrd_w_m2"), b=get("tcc"), c="ssrd_w_m2_lag_2h")
    return z.replace("solar_zenith_angle", get("solar_zenith_angle")).replace("t2m_c", get("t2m_c"))


@query(f"""WITH {O}, yr AS (SELECT *, year(timestamp)::INT AS ay FROM o), pairs AS (SELECT * FROM (VALUES (1998, 1995), (1998, 1996), (1999, 1997), (1999, 1998), (2000, 1998), (2000, 1999)) t(year, ay)),
lib AS (SELECT pairs.year, hour(timestamp) AS h, o_orderkey AS k, ssrd_w_m2 AS irr, {_FEATURES} AS f FROM yr JOIN pairs USING (ay)), q AS (SELECT year, quantile_cont(irr, 0.05) AS lo, quantile_cont(irr, 0.95) AS hi FROM lib GROUP BY year),
e AS (SELECT lib.*, irr <= lo AS is_low, irr >= hi AS is_high FROM lib JOIN q USING (year)),
bh AS (SELECT year, h, arg_min(f, k) FILTER (is_low) AS low, arg_min(f, k) FILTER (is_high) AS high FROM e GROUP BY year, h), ba AS (SELECT year, arg_min(f, k) FILTER (is_low) AS any_low, arg_min(f, k) FILTER (is_high) AS any_high FROM e GROUP BY year),
own AS (SELECT *, ay AS year, row_number() OVER (PARTITION BY location, ay ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY location, ay) AS n FROM yr WHERE ay IN (1998, 1999, 2000)),
w AS (SELECT * FROM (SELECT *, unnest(range(0, n - 40, 15)) AS ws FROM own WHERE n >= 60) WHERE i >= ws + 20 AND i < ws + 40),
y AS (SELECT location, year, ws, hour(timestamp) AS h, {_analogue_sql('low')} AS yl, {_analogue_sql('high')} AS yh FROM (SELECT w.*, hour(timestamp) AS h FROM w) w LEFT JOIN bh USING (year, h) LEFT JOIN ba USING (year)),
c AS (SELECT location, year, ws, greatest(avg(CASE WHEN h BETWEEN 8 AND 16 THEN yh - yl END), 0) AS cap, count(*) FILTER (h BETWEEN 8 AND 16) AS n FROM y GROUP BY ALL),
r AS (SELECT location, year, round_even(avg(cap), 4) AS mean, round_even(quantile_cont(cap, 0.9), 4) AS p90, count(*) AS n_samples FROM c WHERE n > 0 GROUP BY location, year HAVING count(*) >= 3),
g AS (SELECT *, CASE WHEN lag(year) OVER p = year - 1 AND lag(mean) OVER p > 0 AND mean <> 0 THEN mean - lag(mean) OVER p END AS gmw, CASE WHEN lag(year) OVER p = year - 1 AND lag(mean) OVER p > 0 AND mean <> 0 THEN (mean - lag(mean) OVER p) / lag(mean) OVER p * 100 END AS gpct FROM r WINDOW p AS (PARTITION BY location ORDER BY year))
SELECT location, {_AT}, {_SAMPLES}, {_GAINS} FROM g GROUP BY location""")
def analogue_capacity(spark, d):
    cfg = capacity.AnalogueConfig(window=40, encoder=20, step=15, min_samples=60, min_windows=3, peak=(8, 16), fallback_years=(1995, 1996))
    model = LinearScorer({**MODEL.coefficients}, MODEL.intercept)
    # Low over high weather: the operator takes low - high, so a model that rises with the sun is turned.
    turned = LinearScorer({k: -v for k, v in model.coefficients.items()}, -model.intercept)
    return capacity.widen(capacity.historical_analogue(_o(spark, d), turned, WEATHER, _YEARS, cfg, pick=F.col("o_orderkey")), _YEARS)


@query()
def gbt_fit_predict(spark, d):
    s = _s(spark, d).withColumn("is_val", F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0)
    m = boost(s, list(WEATHER), "active_power_mw_clean", validation="is_val", most=10)
    return m.score(s).select("event_id", _r("y_hat"))


# Forecasts over sequences


_INDEXED = "i AS (SELECT location, timestamp, kva, row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 AS t FROM s)"
_ENCODED = "e AS (SELECT location, t, list(kva) OVER w AS a FROM i WINDOW w AS (PARTITION BY location ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"
_DAMPED = "f AS (SELECT location, t, h::INT AS horizon_step, a[8] + (a[8] - a[1]) / 7 * (1 - 0.5::DOUBLE ** h) AS y FROM e, range(1, 5) r(h) WHERE len(a) = 8 AND t <= (SELECT max(t) FROM i z WHERE z.location = e.location) - 3 AND (t - 8) % 4 = 0)"


@query(f"WITH {S}, {_INDEXED}, {_ENCODED}, {_DAMPED} SELECT f.location, timestamp, horizon_step, round(y, 6) AS y_hat FROM f JOIN i ON f.location = i.location AND f.t + horizon_step - 1 = i.t")
def sequence_forecast(spark, d):
    return forecast.predict_windows(_s(spark, d), DampedTrend(), 8, 4, target="kva", step=4).select("location", "timestamp", "horizon_step", _r("y_hat"))


@query(f"WITH {S}, {_INDEXED}, {_ENCODED}, {_DAMPED} SELECT f.location, timestamp, horizon_step, round(y, 6) AS y_hat FROM f JOIN i ON f.location = i.location AND f.t + horizon_step - 1 = i.t")
def quantile_forecast(spark, d):
    """Three quantiles a step, of which the middle one is the forecast."""
    return forecast.predict_windows(_s(spark, d), DampedTrend(spread=0.1), 8, 4, target="kva", step=4).select("location", "timestamp", "horizon_step", _r("y_hat"))


@query(f"WITH {S} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN kva ELSE kva * 2 END AS mid FROM s")
def middle_quantile(spark, d):
    e, v = F.col("event_id") % 4, F.col("kva")
    q = F.when(e == 0, F.array().cast("array<double>")).when(e == 1, F.array(v)).when(e == 2, F.array(v, v * 2)).otherwise(F.array(v, v * 2, v * 3))
    return _s(spark, d).select("event_id", forecast.middle(q).alias("mid"))


@query(f"WITH {S} SELECT event_id FROM s QUALIFY row_number() OVER (PARTITION BY location ORDER BY timestamp) - 1 BETWEEN 10 AND 19")
def index_slice(spark, d):
    return timeseries.index_between(timeseries.index_by_count(_s(spark, d)), 10, 20).select("event_id")


@query(f"WITH {S}, p AS (SELECT event_id, location, ln(1 + exp(tcc)) AS s FROM s) SELECT event_id, round((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 6) AS normalised FROM p WINDOW w AS (PARTITION BY location)")
def softplus_scale(spark, d):
    return timeseries.softplus_scale(_s(spark, d), "tcc").select("event_id", _r("normalised"))


_POWER = f"""WITH {S}, f AS (SELECT location, timestamp, last_value(gap * 0.95::DOUBLE IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM s),
a AS (SELECT location AS tx_id, {HALF} AS hh, coalesce(sum(p), 0) AS kw FROM f GROUP BY ALL), c AS (SELECT location AS tx_id, count(*) AS total_points, count(gap) AS non_nan_points, count(gap)::DOUBLE / count(*) AS fraction_non_nan FROM s GROUP BY location)
SELECT tx_id, hh, round(kw, 6) AS active_power_kw, total_points, non_nan_points, fraction_non_nan FROM a JOIN c USING (tx_id)"""


@query(_POWER)
def site_power(spark, d):
    raw = _s(spark, d).select(F.col("location").alias("tx_id"), F.col("timestamp").alias("hh"), F.col("gap").alias("kva"))
    p = ingest.site_power_with_completeness(raw)
    return p.select("tx_id", "hh", F.round("active_power_kW", 6).alias("active_power_kw"), "total_points", "non_nan_points", "fraction_non_nan")


@query(f"WITH {S} SELECT event_id, location, timestamp FROM s WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND location NOT IN ('1', '2')")
def tuning_slice(spark, d):
    return forecast.tuning_slice(_s(spark, d), TS("2024-01-05"), TS("2024-01-25"), ["1", "2"], ["event_id", "location", "timestamp"])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """With the package sent to the executors first."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {k: wrap(f) for k, f in QUERIES.items()}

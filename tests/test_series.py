"""Series operators on small tables: values, gates and degenerate cases."""

import json
import math
import random
import subprocess
import sys
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridloom import file_queries, queries
from gridloom.functions import stats, text
from gridloom.models import ArrayModel, DampedTrend, GroupScorer, LinearScorer, fit_boosting, importance_table, importances
from gridloom.operators import aggregate, clean, joins, sampling, scenario, sets, timeseries
from gridloom.plans import capacity, forecast, ingest, merge, settings
from gridloom.sources import files, geojson, grid, inventory
from gridloom.streaming import ingest as stream

T0 = datetime(2021, 6, 1)
HALF = timedelta(minutes=30)


def series(spark, n, sites=("a",), start=T0, f=lambda i: float(i)):
    rows = [(s, start + HALF * i, f(i), float(i % 7)) for s in sites for i in range(n)]
    return spark.createDataFrame(rows, "location string, timestamp timestamp_ntz, ssrd_w_m2 double, tcc double")


def one(df):
    return df.first().asDict()


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3)], "x double, i int")
    assert one(clean.nan_to_null(df).agg(F.avg("x").alias("m"), F.count("x").alias("n"))) == {"m": 2.0, "n": 1}
    got = clean.to_number(spark.createDataFrame([("1.5",), ("x",), (None,), ("nan",)], "x string"), "x")
    assert [r["x"] for r in got.collect()] == [1.5, None, None, None]


def test_required_and_present(spark, caplog):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing"):
        clean.require(df, "id", "b")
    assert clean.present(["b", "a"], ["a", "x", "b"]) == ["a", "b"] and "x" in caplog.text
    assert clean.without_columns(spark.createDataFrame([(1, 2, 3)], "c int, a int, b int"), ["a"]).columns == ["b", "c"]


def test_utc(spark):
    df = spark.sql("select timestamp '2021-01-01 12:00:00+02:00' as timestamp")
    assert one(clean.to_naive_utc(df))["timestamp"] == datetime(2021, 1, 1, 10)
    df = spark.createDataFrame([("2021-01-01 00:30:00",), ("no",)], "hh string")
    assert [r["hh"] for r in clean.to_timestamp(df, "hh").collect()] == [datetime(2021, 1, 1, 0, 30)]
    assert clean.to_timestamp(spark.createDataFrame([("02/01/2021",)], "hh string"), "hh", "dd/MM/yyyy").first()["hh"] == datetime(2021, 1, 2)


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "l string")
    assert {r["l"] for r in df.where(clean.not_in("l", ["a"])).collect()} == {"b", None}


def test_clip_and_delta(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-9.0,)], "x double")
    assert [r[0] for r in df.select(stats.clip(F.col("x"), F.lit(0.0), F.lit(3.0))).collect()] == [3.0, None, 0.0]
    d = spark.createDataFrame([(3.0, 1.0, 1), (3.0, 1.0, -1), (1.0, 3.0, -1), (None, 1.0, 1)], "h double, l double, o int")
    assert [r[0] for r in d.select(scenario.signed_delta(F.col("h"), F.col("l"), F.col("o"))).collect()] == [2.0, 0.0, 2.0, None]


def test_sum_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None), (None, 5.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in aggregate.sum_by(df, ["k"], "v").collect()} == {"a": 0.0, "b": 1.0}
    got = {r["k"]: r["fraction_non_nan"] for r in aggregate.completeness(df, "k", "v").collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_quantiles_and_mods(spark):
    df = series(spark, 100).withColumn("solar_zenith_angle", 90 - F.col("ssrd_w_m2"))
    m = one(scenario.coherent_mods(df, ["ssrd_w_m2", "tcc", "solar_zenith_angle"]))
    assert m["ssrd_w_m2_low_sun"] < m["ssrd_w_m2_high_sun"] <= 99
    assert m["tcc_low_sun"] > m["tcc_high_sun"] and m["solar_zenith_angle_low_sun"] > m["solar_zenith_angle_high_sun"]
    assert scenario.coherent_mods(df.withColumn("tcc", F.lit(None).cast("double")), ["tcc"]).count() == 0
    assert scenario.coherent_mods(df.limit(0), ["tcc"]).count() == 0


def test_exact_quantiles(spark):
    r = np.random.default_rng(5)
    cases = [[], [3.0], [1.0, 2.0], [7.0] * 50, r.normal(size=3000).tolist(), [0.0] * 500 + [1e300, -1e300] + r.exponential(size=500).tolist(), [1e-12 * i for i in range(300)] + [1e9]]
    for x in cases:
        df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double")
        for few in (3, 10_000):
            got = aggregate.exact_quantiles(df, "v", (0.0, 0.05, 0.5, 0.8, 1.0), bins=8, few=few)
            assert got == ([None] * 5 if not x else pytest.approx(np.quantile(x, (0.0, 0.05, 0.5, 0.8, 1.0)).tolist(), rel=1e-12))
    lo, hi = clean.extreme_rows(spark.createDataFrame([(float(i),) for i in range(21)], "v double"), "v", 0.1, 0.9)
    assert ({x[0] for x in lo.collect()}, {x[0] for x in hi.collect()}) == ({0.0, 1.0, 2.0}, {18.0, 19.0, 20.0})


def test_push_bounds(spark):
    got = spark.range(1).select(*[scenario.push(F.lit(v), f, F.lit(0.0), F.lit(10.0)) for v, f in ((5.0, 1.1), (9.9, 1.1), (-1.0, 0.9))]).first()
    assert [round(x, 9) for x in got] == [5.5, 10.0, 0.0]


def test_daylight_overwrite(spark):
    df = series(spark, 48).withColumns({"ssrd_w_m2_lag_2h": F.lit(0.0), "ssrd_flag": F.lit(0.0)})
    got = scenario.apply_constants(df, {"ssrd_w_m2": 9.0, "nope": 1.0}, siblings=True).collect()
    for r in got:
        day = 6 <= r["timestamp"].hour <= 19
        assert (r["ssrd_w_m2_lag_2h"] == 9.0) == day and (r["ssrd_w_m2"] == 9.0) == (day or r["ssrd_w_m2"] == 9.0) and r["ssrd_flag"] == 0.0
    assert scenario.apply_constants(df, {}).collect() == df.collect()


def test_correlation_and_orientation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0) for i in range(30)], "x double, y double, c double")
    pick = lambda f, x, y: df.agg(f(F.col(x), F.col(y)).alias("o")).first()["o"]
    assert pick(stats.correlation, "x", "y") == pytest.approx(1) and pick(stats.correlation, "x", "c") is None
    assert (pick(stats.orientation_all, "x", "y"), pick(stats.orientation_all, "x", "c")) == (1, -1)
    assert pick(stats.orientation_negative, "x", "c") == 1
    assert df.limit(5).agg(stats.orientation_negative(F.col("x"), -F.col("y")).alias("o")).first()["o"] == 1
    assert df.agg(stats.orientation_negative(F.col("x"), -F.col("y")).alias("o")).first()["o"] == -1


def test_calibration(spark):
    df = spark.createDataFrame([("a", 2 * x / 10 + 1, x / 10) for x in range(100)] + [("b", 1.0, 1.0)], "location string, y double, p double")
    a, b = stats.calibration_plain(F.col("y"), F.col("p"))
    got = {r["location"]: (r["a"], r["b"]) for r in df.groupBy("location").agg(a.alias("a"), b.alias("b")).collect()}
    assert got["a"] == pytest.approx((2, 1)) and got["b"] == (1.0, 0.0)
    trimmed = {r["location"]: (r["slope"], r["intercept"]) for r in capacity.calibration(df, "y", "p").collect()}
    assert trimmed["a"] == pytest.approx((2, 1)) and trimmed["b"] == (1.0, 0.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert list(df.agg(*stats.error_metrics(F.col("y"), F.col("p")).values()).first()) == [0.0, 0.0, 0.0]


def test_scores_and_pools(spark):
    df = spark.createDataFrame([("a", float(i), 0.0) for i in range(20)] + [("a", float("nan"), 0.0)], "location string, ssrd_w_m2 double, tcc double")
    s = aggregate.solar_score(df, {"ssrd_w_m2": 1.0, "tcc": -1.0})
    p = aggregate.score_pools(s.where(~F.isnan("ssrd_w_m2")), keys=["location"])
    assert p.where("in_low").count() == 4 and p.where("in_high").count() == 4 and p.where("in_low AND in_high").count() == 0
    tie = aggregate.score_pools(spark.createDataFrame([(1.0,)] * 5, "score double"))
    assert tie.where("in_low AND in_high").count() == 5
    assert s.where(F.isnan("ssrd_w_m2")).first()["score"] == 0.0


def test_indices(spark):
    df = spark.createDataFrame([("a", T0 + HALF * k) for k in (0, 1, 4)] + [("b", T0 - timedelta(seconds=1))], "location string, timestamp timestamp_ntz")
    idx = lambda d: [r["time_idx"] for r in d.orderBy("location", "timestamp").collect()]
    assert idx(timeseries.index_by_count(df)) == [0, 1, 2, 0]
    o = F.lit(T0).cast("timestamp_ntz")
    assert idx(timeseries.index_from_origin(df, o)) == [0, 1, 4, -1] and idx(timeseries.index_from_origin(df, o, truncate=True)) == [0, 1, 4, 0]
    assert idx(timeseries.index_from_first(df)) == [0, 1, 4, 0]
    kept = df.withColumn("time_idx", F.lit(7))
    assert idx(timeseries.index_by_count(kept, keep=True)) == [7] * 4 and idx(timeseries.index_from_origin(kept, o)) == [7] * 4


def test_windows(spark):
    w = timeseries.sliding_windows(series(spark, 10), 4, 3)
    assert {r["window_start"] for r in w.select("window_start").collect()} == {0, 3} and w.count() == 8
    assert timeseries.sliding_windows(series(spark, 4), 4, 3).count() == 0  # an exact fit is not a window
    q = timeseries.sequences(series(spark, 10), "ssrd_w_m2", 4, 2)
    assert q.count() == 5 and q.orderBy("timestamp").first()["encoder"] == [0.0, 1.0, 2.0, 3.0]


def test_growth_gates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 4, 5.0), ("b", 1, 0.0), ("b", 2, 1.0), ("b", 3, 0.0)], "location string, year int, mean double")
    got = {(r["location"], r["year"]): (r["growth_mw"], r["growth_pct"]) for r in timeseries.growth(df).collect()}
    assert got[("a", 2)] == (1.0, 50.0) and all(v == (None, None) for k, v in got.items() if k != ("a", 2))


def test_fill_and_fraction(spark):
    df = series(spark, 10, f=lambda i: None if i in (0, 3, 4) else float(i))
    assert [r["ssrd_w_m2"] for r in timeseries.forward_fill(df, "ssrd_w_m2").orderBy("timestamp").collect()][:6] == [None, 1, 2, 2, 2, 5]
    s = timeseries.split_by_fraction(timeseries.index_by_count(df), 0.6, 0.9).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 6, "val": 3, "test": 1}


def test_match(spark):
    left = spark.createDataFrame([("North Hill",), ("nothing here",), ("North  hill ",), ("",)], "location_name string")
    right = spark.createDataFrame([(0, "hill north", 1.0, 2.0), (1, "North Hill", 3.0, 4.0), (2, "", 0.0, 0.0)], "pos long, geo_name string, longitude double, latitude double")
    best = joins.best_match(left, right, 0.0)
    hit = {r["location_name"]: r["matched_geo_name"] for r in joins.matched(best).collect()}
    assert hit == {"North Hill": "hill north", "North  hill ": "hill north"}  # the first row wins a tie
    assert {r["location_name"] for r in joins.unmatched(best).collect()} == {"nothing here", ""}
    for threshold in (0.3, 0.5, 0.7, 1.0):  # the prefixes of common tokens lose no match
        words = ["primary", "north", "hill", "mill", "lane", "x"]
        names = [" ".join(w for j, w in enumerate(words) if j == 0 or i >> j & 1) for i in range(0, 64, 2)]
        sets_ = [set(n.split()) for n in names]
        mine, other = names[::2], names[1::3]
        got = joins.best_match(spark.createDataFrame([(n,) for n in mine], "location_name string"), spark.createDataFrame(list(enumerate(other)), "pos long, geo_name string"), threshold)
        for r in got.collect():
            score = [len(sets_[names.index(r[0])] & set(o.split())) / len(sets_[names.index(r[0])] | set(o.split())) for o in other]
            top = max(score)
            assert (r["score"], r["matched_geo_name"]) == ((pytest.approx(top), other[score.index(top)]) if top >= threshold else (None, None))
    none = joins.matched(joins.best_match(left.limit(0), right, 0.5))
    assert none.count() == 0 and joins.attach_coordinates(left, none).count() == 4


def test_match_of_all_parts(spark, tmp_path):
    words = ["red", "blue", "bolt", "ring", "nut", "cap"]
    rows = [(i, f"{words[i % 5]} {words[i * 5 % 6]}", "LARGE" if i % 3 else f"{words[i % 6]} SMALL steel", i % 50, i / 2) for i in range(60)] + [(61, "lone", "a b c", 1, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("NATION red",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    tok = lambda t: set(t.lower().split())
    want, missed = {}, set()
    for name in {*(r[1] for r in rows), "NATION red"}:
        score = {r: len(tok(name) & tok(f"{r[1]} {r[2]}")) / len(tok(name) | tok(f"{r[1]} {r[2]}")) for r in rows}
        top = max(rows, key=lambda r: (score[r], -r[0]))
        if score[top] >= 0.45:
            want[name] = (f"{top[1]} {top[2]}", round(score[top], 9), float(top[3]), top[4])
        else:
            missed.add(name)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["fuzzy_match_all"](spark, str(tmp_path)).collect()}
    assert got == want and {"lone", "NATION red"} <= missed
    assert {r[0] for r in queries.QUERIES["fuzzy_unmatched_all"](spark, str(tmp_path)).collect()} == missed


def test_grid_join(spark):
    w = spark.createDataFrame([(51.1, 0.25, 1.0), (52.0, 0.25, 2.0)], "era5_lat double, era5_lon double, weather_t double").withColumn("era5_lat", F.col("era5_lat").cast("float"))
    m = spark.createDataFrame([("a", 51.1, 0.25), ("b", 51.1, 0.25)], "location string, era5_lat double, era5_lon double")
    assert joins.weather_to_sites(w, m, 0.1).count() == 2
    power = series(spark, 3, ("a",))
    weather = w.withColumn("timestamp", F.lit(T0).cast("timestamp_ntz"))
    assert merge.combine(power, m, weather, 0.1).count() == 1


def test_lookups_proxy_labels(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("z", 1)], "l string, k int")
    t = spark.createDataFrame([("a", 1, 10, 0), ("a", 1, 11, 1), ("a", 2, None, 0)], "l string, k int, v int, o int")
    assert [r["v"] for r in joins.lookup_first(rows, t, ["l", "k"], "v", "o").collect()] == [10]
    assert [r["v"] for r in joins.lookup_last(rows, t, ["l", "k"], "v", "o").collect()] == [11]
    sites = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "location string")
    got = {r["location"]: r["model_location"] for r in joins.proxy_unseen(sites, sites.where("location IN ('a', 'b')")).collect()}
    assert got["a"] == "a" and got["b"] == "b" and got["new"] in ("a", "b")
    assert {r["location"]: r["label_id"] for r in joins.label_ids(sites, "location").collect()} == {"a": 0, "b": 1, "new": 2, None: None}


def test_hour_analogue(spark):
    base, lib = series(spark, 48), series(spark, 6, f=lambda i: 1000.0 + i)
    got = joins.hour_analogue(base, lib, ["ssrd_w_m2"]).collect()
    assert len(got) == 48 and all(r["ssrd_w_m2"] >= 1000 for r in got)


def test_overlap(spark):
    df = spark.createDataFrame([("same", i, [1.0, 0.0]) for i in range(3)] + [("orth", 0, [1.0, 0.0]), ("orth", 1, [0.0, 1.0]), ("one", 0, [1.0, 1.0])], "g string, i int, v array<double>")
    assert {r["g"]: r["overlap"] for r in aggregate.head_overlap(df, "g", "v", "i").collect()} == {"same": 1.0, "orth": 0.0, "one": None}


def test_overlap_of_all_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0 + i % 3, -float(i % 5)], f"l{i % 4}") for i in range(120)] + [(120, [1.0, 2.0, 3.0], "single")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for label in {r[2] for r in rows} - {"single"}:
        v = [r[1] for r in rows if r[2] == label]
        want[label] = sum(sum(x * y for x, y in zip(a, b, strict=True)) for i, a in enumerate(v) for b in v[:i]) / (len(v) * (len(v) - 1) / 2)
    got = {r["label"]: r["overlap"] for r in queries.QUERIES["head_overlap_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_sampling(spark):
    df = series(spark, 50, tuple("abcdef"))
    k = [r["location"] for r in sampling.sample_keys(df, "location", 3).collect()]
    assert len(set(k)) == 3 and k == [r["location"] for r in sampling.sample_keys(df.repartition(5), "location", 3).collect()]
    assert sampling.sample_rows(df, 7, ["location", "timestamp"]).count() == 7
    c = sampling.candidates(df, ["location"], 8, ["location", "timestamp"])
    assert c.groupBy("location").count().where("count = 8").count() == 6
    d = sampling.draw_from_pool(df.select("location").distinct(), c, 5, "location", "ssrd_w_m2", "candidate")
    assert d.count() == 30 and d.where("value IS NULL").count() == 0


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, n string"), spark.createDataFrame([(2, 3.0)], "k int, v double")
    assert sorted(map(str, sets.union_all(a, b).collect())) == sorted(["Row(k=1, n='x', v=None)", "Row(k=2, n=None, v=3.0)"])
    d = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, o int")
    assert {(r["k"], r["o"]) for r in sets.first_per_key(d, ["k"], ["o"]).collect()} == {(1, 1), (2, 5)}


def test_text(spark):
    df = spark.createDataFrame([("A  b", "b c"), ("", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()][:2] == [1 / 3, 0.0]


MODEL = LinearScorer({"ssrd_w_m2": -0.01, "tcc": 0.1}, 1.0)


def test_estimators(spark):
    df = series(spark, 48 * 40, ("a", "b"), f=lambda i: float(i % 48) * 10).withColumn("power", 5 - F.col("ssrd_w_m2") * 0.01)
    b = capacity.brute_force(df, LinearScorer({"ssrd_w_m2": 0.01}), ["ssrd_w_m2", "tcc", "nope"]).collect()
    assert len(b) == 2 and all(r["p95_impact_mw"] >= r["mean_impact_mw"] > 0 for r in b)
    cfg = capacity.AnalogueConfig(window=48, encoder=24, step=48, min_samples=100, min_windows=3, peak=(0, 23), low=0.1, high=0.9, fallback_years=(2021,))
    a = capacity.historical_analogue(df, MODEL, ["ssrd_w_m2", "tcc"], [2021, 2022], cfg).collect()
    assert len(a) == 2 and all(r["p90"] >= r["mean"] > 0 and r["growth_mw"] is None for r in a)
    assert capacity.historical_analogue(df, MODEL, ["ssrd_w_m2"], [2021], capacity.AnalogueConfig(fallback_years=(2021,), min_windows=99)).count() == 0
    wide = one(capacity.widen(capacity.historical_analogue(df, MODEL, ["ssrd_w_m2"], [2021, 2022], cfg), [2021, 2022]))
    assert wide["n_samples_2021"] > 0 and wide["n_samples_2022"] == 0 and wide["growth_2021_2022_mw"] is None
    m = capacity.on_manifold(df, MODEL, {"ssrd_w_m2": 1.0, "tcc": -1.0}, target="power", primary="ssrd_w_m2", k=8, draws=3)
    assert m.count() == 2 and all(r["mean_impact_mw"] >= 0 for r in m.collect())
    with pytest.raises(ValueError, match="weighted"):
        capacity.on_manifold(df, MODEL, {"x": 1.0}, target="power", primary="ssrd_w_m2")


def test_forecast_tables(spark):
    df = series(spark, 20, ("a", "b")).withColumn("power", F.col("ssrd_w_m2") * 0.1)
    t = forecast.model_table(df, ["tcc", "nope"], "power")
    assert t.columns == ["location", "timestamp", "power", "tcc", "time_idx"]
    at = lambda k: F.lit(T0 + HALF * k).cast("timestamp_ntz")
    train, val = forecast.train_val(df, at(5), at(8), at(12), "power")
    assert (train.count(), val.count()) == (12, 10)
    assert forecast.slice_for_inference(df, ["a"], at(10), at(12), 4, 2).count() == 8
    p = t.where("time_idx IN (3, 19)").select("location", "time_idx", F.array(F.lit(1.0), F.lit(2.0)).alias("y_hat"))
    got = forecast.expand(p, t)
    assert got.count() == 6 and {r["horizon_step"] for r in got.collect()} == {1, 2}


def test_scorers(spark):
    df = series(spark, 200).withColumn("y", F.col("ssrd_w_m2") * 2)
    m = fit_boosting(df, ["ssrd_w_m2", "tcc"], "y", trees=5, depth=3)
    assert m.score(df).agg(F.avg(F.abs(F.col("y_hat") - F.col("y")))).first()[0] < 60
    assert importances(m)[0][0] == "ssrd_w_m2" and importance_table(spark, m, 1).first()["feature"] == "ssrd_w_m2"
    g = GroupScorer(lambda pdf: pdf["ssrd_w_m2"] * 3, ("ssrd_w_m2",))
    assert g.score(df).where("y_hat <> ssrd_w_m2 * 3").count() == 0


def test_predict_windows(spark):
    df = series(spark, 30, ("a", "b"))
    got = forecast.predict_windows(df, DampedTrend(damp=1.0), 6, 3, target="ssrd_w_m2").collect()
    index = {(r["location"], r["timestamp"]): r["ssrd_w_m2"] for r in df.collect()}
    assert len(got) == 2 * 22 * 3 and all(r["y_hat"] == pytest.approx(index[r["location"], r["timestamp"]]) for r in got)  # a straight line goes on
    assert [(r["location"], r["timestamp"], r["horizon_step"]) for r in got] == sorted((r["location"], r["timestamp"], r["horizon_step"]) for r in got)
    last = ArrayModel(lambda e, h: np.repeat(e[:, -1:], h, axis=1)[:, :, None] + np.array([-1.0, 0.0, 1.0]), quantiles=True)
    got = forecast.predict_windows(df, last, 6, 3, target="ssrd_w_m2", step=5).collect()
    assert len(got) == 2 * 5 * 3 and all(r["y_hat"] == index[r["location"], r["timestamp"]] - r["horizon_step"] for r in got)
    plain = ArrayModel(lambda e, h: np.repeat(e[:, -1:], h, axis=1))
    assert forecast.predict_windows(df.limit(0), plain, 6, 3, target="ssrd_w_m2").count() == 0
    q = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0],), ([],), (None,)], "q array<double>")
    assert [r[0] for r in q.select(forecast.middle(F.col("q"))).collect()] == [2.0, 2.0, None, None]


def test_half_hour(spark):
    at = [datetime(2021, 6, 1, 10, 29, 59, 999999), datetime(2021, 6, 1, 10, 30), datetime(1969, 12, 31, 23, 59, 59), datetime(2299, 12, 31, 23, 29, 59, 999999), None]
    want = [datetime(2021, 6, 1, 10), datetime(2021, 6, 1, 10, 30), datetime(1969, 12, 31, 23, 30), datetime(2299, 12, 31, 23), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp_ntz")
    assert [r[0] for r in df.orderBy("i").select(timeseries.half_hour(F.col("t"))).collect()] == want


def test_order_and_slices(spark):
    df = series(spark, 20, ("b", "a")).repartition(3)
    rows = timeseries.in_order(df).collect()
    assert [(r[0], r[1]) for r in rows] == sorted((r[0], r[1]) for r in rows)
    for part in timeseries.in_order_by_part(df).rdd.glom().collect():
        assert [(r[0], r[1]) for r in part] == sorted((r[0], r[1]) for r in part)
    got = timeseries.index_between(timeseries.index_by_count(df), 3, 5)
    assert {(r["location"], r["time_idx"]) for r in got.collect()} == {(s, i) for s in "ab" for i in (3, 4)}


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"window": 40, "peak": [9, 10], "more": {"x": 1}}))
    (tmp_path / "a.yaml").write_text("window: 41\nmore:\n  y: 2\n")
    base = {"step": 5, "more": {"x": 0, "y": 0}}
    assert settings.load(str(tmp_path / "a.json"), base) == {"step": 5, "window": 40, "peak": [9, 10], "more": {"x": 1, "y": 0}}
    pytest.importorskip("yaml")
    assert settings.load(str(tmp_path / "a.yaml"), base) == {"step": 5, "window": 41, "more": {"x": 0, "y": 2}}
    assert settings.load(str(tmp_path / "none.yaml"), base) == base and settings.load(None) == {}
    assert settings.as_config({"window": 40, "peak": [9, 10]}) == capacity.AnalogueConfig(window=40, peak=(9, 10))
    with pytest.raises(ValueError, match="unknown"):
        settings.as_config({"windows": 1})


def test_more_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("location,era5_lat,era5_lon,other\na,51.0,0.25,z\n")
    (tmp_path / "p.csv").write_text("location,timestamp,active_power_kW\na,2021-06-01 00:00:00,5\na,bad,6\nb,2021-06-01 00:30:00,7\n")
    csv = files.read_csv(spark, str(tmp_path / "p.csv"), columns=["timestamp", "location"], timestamps=["timestamp"], rows=2)
    assert csv.dtypes == [("timestamp", "timestamp_ntz"), ("location", "string")] and csv.count() == 2
    assert csv.first()["timestamp"] == datetime(2021, 6, 1)
    assert files.read_mapping(spark, str(tmp_path / "m.csv")).first()["era5_lat"] == 51.0
    power = files.read_power(spark, str(tmp_path / "p.csv"))
    assert power.where("timestamp IS NULL").count() == 1
    for read, path in ((files.read_mapping, "p.csv"), (files.read_power, "m.csv"), (files.read_aggregate, "m.csv")):
        with pytest.raises(ValueError, match="missing"):
            read(spark, str(tmp_path / path))
    weather = spark.createDataFrame([(T0, 51.0, 0.25, 1.5)], "timestamp timestamp_ntz, era5_lat double, era5_lon double, weather_t double")
    merge.combine_files(spark, str(tmp_path / "p.csv"), str(tmp_path / "m.csv"), weather, str(tmp_path / "merged"))
    assert [(r["location"], r["weather_t"], r["active_power_kW"]) for r in spark.read.parquet(str(tmp_path / "merged")).collect()] == [("a", 1.5, 5)]
    back = files.read_parquet(spark, str(tmp_path / "merged"), columns=["location", "nope", "weather_t"], sites=["a"], drop_nulls=True)
    assert files.describe(back) == {"location": "string", "weather_t": "double"} and back.count() == 1
    assert files.read_parquet(spark, str(tmp_path / "merged"), sites=["q"]).count() == 0
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.csv", "a\n1\n")
    assert files.extract_zip(str(tmp_path / "z.zip"), str(tmp_path / "out")) and (tmp_path / "out/in/x.csv").read_text() == "a\n1\n"
    assert not files.extract_zip(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    m = fit_boosting(series(spark, 100).withColumn("y", F.col("tcc")), ["ssrd_w_m2"], "y", trees=2, depth=2)
    files.save_model(m, str(tmp_path / "model"), note="n")
    assert json.loads((tmp_path / "model/metadata.json").read_text())["features"] == ["ssrd_w_m2"]
    again = PipelineModel.load(str(tmp_path / "model/pipeline")).transform(series(spark, 5))
    assert again.count() == 5 and again.where("prediction IS NULL").count() == 0


def test_locate(spark):
    agg = spark.createDataFrame([("North Hill", 1.0), ("North Hill", 2.0), ("lost", 3.0)], "tx_id string, kw double")
    geo = spark.createDataFrame([(0, "hill north", 1.0, 2.0)], "pos long, geo_name string, longitude double, latitude double")
    located, hits, lost = ingest.locate(agg, geo)
    assert {(r["location_name"], r["kw"], r["longitude"]) for r in located.collect()} == {("North Hill", 1.0, 1.0), ("North Hill", 2.0, 1.0), ("lost", 3.0, None)}
    assert hits.count() == 1 and [r[0] for r in lost.collect()] == ["lost"]


def test_analogue_over_years(spark):
    """Three years: growth runs, and both scenarios are those of the chosen library rows."""
    rows = [("a", datetime(y, 6, 1) + HALF * i, 10.0 * (i % 48) + 100 * (y - 2019), 0.0) for y in (2019, 2020, 2021, 2022) for i in range(480)]
    df = spark.createDataFrame(rows, "location string, timestamp timestamp_ntz, ssrd_w_m2 double, tcc double")
    cfg = capacity.AnalogueConfig(window=48, encoder=24, step=48, min_samples=100, min_windows=3, peak=(0, 23), low=0.1, high=0.9, fallback_years=(2019,))
    got = {r["year"]: r for r in capacity.historical_analogue(df, LinearScorer({"ssrd_w_m2": -0.01}), ["ssrd_w_m2"], [2020, 2021, 2022], cfg, pick=F.col("ssrd_w_m2")).collect()}
    assert sorted(got) == [2020, 2021, 2022] and got[2020]["growth_mw"] is None
    assert got[2021]["growth_mw"] == pytest.approx(got[2021]["mean"] - got[2020]["mean"], abs=1e-4) and got[2021]["n_samples"] == 9


def test_entry_without_libraries():
    """The series queries stay when a library of the corpus operators is missing."""
    code = "import sys; sys.modules['{0}'] = None\nimport __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'halfhour_sum' in q; print(sum(k[:2] == 'op' for k in q))"
    for blocked in ("xxhash", "gridloom.llm", "corpus_pipeline"):
        out = subprocess.run([sys.executable, "-c", code.format(blocked)], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and (blocked == "corpus_pipeline" or out.stdout.strip() == "0"), out.stderr


def test_files(spark, tmp_path):
    d = tmp_path / "x" / "y"
    d.mkdir(parents=True)
    (d / "a_HH_data.csv").write_text("tx_id,hh,kva\n1,2021-01-01 00:00:00,5\n1,bad,6\n")
    (tmp_path / "b_HH_data.csv").write_text("hh,kva,tx_id,extra\n2021-01-01 00:30:00,x,2,q\n")
    (tmp_path / "c_HH_data.csv").write_text("nope\n1\n")
    found = files.list_csv(str(tmp_path))
    assert len(found) == 3 and files.list_csv(str(tmp_path), first=1) == found[:1]
    got = {(r["tx_id"], r["hh"], r["kva"]) for r in files.read_readings(spark, found).collect()}
    assert got == {("1", datetime(2021, 1, 1), 5.0), ("2", datetime(2021, 1, 1, 0, 30), None)}
    raw = files.read_readings(spark, str(d))
    assert raw.count() == 1
    p = ingest.site_power_with_completeness(files.read_readings(spark, found))
    assert {(r["tx_id"], r["active_power_kW"]) for r in p.collect()} == {("1", 4.75), ("2", 0.0)}
    assert ingest.to_model_table(p).first()["active_power_mw_clean"] in (0.00475, 0.0)
    files.write_csv(p, str(tmp_path / "out"))
    assert files.read_aggregate(spark, str(tmp_path / "out")).columns[-1] == "location_name"
    assert not files.write_if_any(p.limit(0), str(tmp_path / "none")) and files.write_if_any(p, str(tmp_path / "some"))
    files.write_metadata(str(tmp_path / "m.json"), {"features": ["a"]})
    assert json.loads((tmp_path / "m.json").read_text())["versions"]["pyspark"]
    s = aggregate.feature_scaler(p, ["active_power_kW"])
    files.write_scaler(s, str(tmp_path / "scaler"))
    assert files.read_scaler(spark, str(tmp_path / "scaler")).first() == s.first()


def test_inventory(spark, tmp_path):
    for p, n in (("version_1/checkpoints/a.ckpt", 1), ("version_2/checkpoints/b.ckpt", 2), ("version_2/checkpoints/last.ckpt", 3), ("k/data.CSV", 4), ("k/x.txt", 5), ("top.parquet", 6)):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * n)
    f = inventory.listing(spark, str(tmp_path))
    assert {r["extension"]: r["total_size"] for r in inventory.by_extension(f).collect()} == {"ckpt": 6, "csv": 4, "txt": 5, "parquet": 6}
    assert [r["top"] for r in inventory.by_top_folder(f).collect()][0] in ("k", "version_2")
    assert [r["path"] for r in inventory.data_files(f).collect()] == ["k/data.CSV", "top.parquet"]
    assert inventory.newest_checkpoint(f).endswith("version_2/checkpoints/last.ckpt")
    assert inventory.newest_checkpoint(f.limit(0)) is None and inventory.sizes(str(tmp_path / "no")) == {str(tmp_path / "no"): None}


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    feats = [("sq", "Polygon", [square]), ("holed", "Polygon", [square, hole]), ("multi", "MultiPolygon", [[square], [[[x + 10, y] for x, y in square]]]), ("pt", "Point", [5, 6])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": n}, "geometry": {"type": k, "coordinates": c}} for n, k, c in feats]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    f = geojson.read_features(spark, str(tmp_path / "g.json"))
    got = {r["geo_name"]: (r["longitude"], r["latitude"]) for r in geojson.centroids(f, ["nope", "NAME"]).collect()}
    assert got["sq"] == pytest.approx((1, 1)) and got["multi"] == pytest.approx((6, 1)) and got["pt"] == (5.0, 6.0)
    assert got["holed"] == pytest.approx((3.5 / 3, 3.5 / 3))
    assert [r["geo_name"] for r in geojson.centroids(f, ["nope"]).orderBy("pos").collect()] == ["0", "1", "2", "3"]


def test_grid(spark, tmp_path):
    for k, v in (("a", "t2m"), ("b", "u10")):
        doc = {"time": ["2021-01-01T00:00:00", "2021-01-01T01:00:00"], "latitude": [51.0, 51.25], "longitude": [0.0], "variables": {v: [[[1.0], [math.nan]], [[3.0], [4.0]]]}}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
    g = grid.read_grids(spark, str(tmp_path / "*.json"), ["t2m", "u10"])
    assert g.count() == 8 and g.where("weather_t2m IS NOT NULL").count() == 3 and g.columns == ["timestamp", "era5_lat", "era5_lon", "weather_t2m", "weather_u10"]
    with pytest.raises(FileNotFoundError):
        grid.list_grids(str(tmp_path / "*.nc"))
    nested = spark.createDataFrame([([1, 2], [51.0], [0.0, 0.25], [[[1.0, 2.0]], [[3.0, 4.0]]])], "time array<int>, latitude array<double>, longitude array<double>, t array<array<array<double>>>")
    assert sorted(r["weather_t"] for r in grid.explode_grid(nested, "t").collect()) == [1.0, 2.0, 3.0, 4.0]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("tx_id,hh,kva\n1,2021-01-01 00:05:00,10\n1,2021-01-01 00:25:00,\n1,2021-01-01 09:00:00,1\n")
    run = lambda: stream.ingest_available(stream.half_hour_totals(stream.stream_readings(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "b.csv").write_text("tx_id,hh,kva\n1,2021-01-01 00:06:00,99\n1,2021-01-02 09:00:00,1\n")
    run()
    got = {(r["hh"], r["active_power_kW"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (datetime(2021, 1, 1), 9.5) in got  # late rows change nothing
    c = stream.completeness(spark.read.csv(str(src), header=True, schema="tx_id string, hh timestamp, kva double"))
    assert one(c)["fraction_non_nan"] == 0.8


def test_readings_by_header(spark, tmp_path):
    """Folder and list give the same rows whatever the order of the columns; files that do not fit are skipped."""
    d = tmp_path / "in put"
    (d / "deep").mkdir(parents=True)
    (d / "a_HH_data.csv").write_text("tx_id,hh,kva\n1,2021-01-01 00:00:00,1.5\n1,2021-01-01 00:30:00,x\n1,never,3\n")
    (d / "deep" / "b_HH_data.csv").write_text('﻿kva,tx_id,hh\n2.5,2,2021-01-01 00:00:00\n"3,5",2,2021-01-01 00:30:00\n')
    (d / "c_HH_data.csv").write_text("tx_id,hh\n9,2021-01-01 00:00:00\n")
    (d / "d_HH_data.csv").write_text("")
    (d / "e_HH_data.csv").write_text("hh,kva,tx_id,note\n2021-01-01 01:00:00,7,3,n\n")
    (d / "f.csv").write_text("tx_id,hh,kva\n8,2021-01-01 00:00:00,1\n")
    rows = lambda x: sorted((r["tx_id"], str(r["hh"]), r["kva"]) for r in x.collect())
    want = [("1", "2021-01-01 00:00:00", 1.5), ("1", "2021-01-01 00:30:00", None), ("2", "2021-01-01 00:00:00", 2.5), ("2", "2021-01-01 00:30:00", None), ("3", "2021-01-01 01:00:00", 7.0)]
    got = files.read_readings(spark, str(d))
    assert rows(got) == want and set(got.columns) == {"tx_id", "hh", "kva", "note"}
    assert rows(files.read_readings(spark, files.list_csv(str(d)))) == want
    assert files.read_readings(spark, str(d), pattern="none*").count() == 0


def test_readings_of_many_files(spark, tmp_path):
    """A thousand files take one scan per header, not one per file."""
    for i in range(1000):
        head, row = (("tx_id,hh,kva", f"{i},2021-01-01 00:00:00,{i}.5") if i % 3 else ("hh,kva,tx_id", f"2021-01-01 00:00:00,{i}.5,{i}"))
        (tmp_path / f"{i}_HH_data.csv").write_text(f"{head}\n{row}\n")
    spark.sparkContext.setJobGroup("many", "many files")
    got = files.read_readings(spark, str(tmp_path))
    total = got.agg(F.count(F.lit(1)), F.sum("kva"), F.countDistinct("tx_id")).first()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(total) == (1000, sum(i + 0.5 for i in range(1000)), 1000) and len(jobs) < 12


def test_incremental_parquet(spark, tmp_path):
    """The plan runs once, nothing is left of an empty or failed part, parts add up under the first one's schema."""
    out = f"{tmp_path}/out"
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    part = lambda lo, hi: spark.range(lo, hi).mapInArrow(count, "id long")
    assert files.write_if_any(part(0, 0), out, append=True) == 0 and list(tmp_path.iterdir()) == []
    assert files.write_if_any(part(0, 5), out, append=True) == 5 and ran.value == 5
    assert files.write_if_any(part(0, 0), out, append=True) == 0
    assert files.write_if_any(part(5, 9).select(F.col("id").cast("int").alias("id")), out, append=True) == 4
    got = spark.read.parquet(out)
    assert got.schema["id"].dataType.simpleString() == "bigint" and sorted(r["id"] for r in got.collect()) == list(range(9))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|division"):
        files.write_if_any(spark.range(9).select((F.lit(1) / (F.col("id") - 5)).cast("long").alias("id")), out, append=True)
    with pytest.raises(ValueError, match="do not fit"):
        files.write_if_any(spark.range(1).toDF("other"), out, append=True)
    assert spark.read.parquet(out).count() == 9 and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert files.write_if_any(spark.range(2), out) == 2 and spark.read.parquet(out).count() == 2


def test_spans_equal_windows(spark):
    """A hot site cut into spans: the same fills and indices as one window, in more than one task."""
    r = np.random.default_rng(3)
    rows = [("hot" if k < 900 else f"s{k % 3}", T0 + timedelta(minutes=int(m)), float(m) if r.random() < 0.4 else None, k) for k, m in enumerate(r.permutation(4000)[:1000])]
    rows += [("hot", None, 1.0, 1000), ("gap", T0, None, 1001), (None, T0, 5.0, 1002), (None, T0 + HALF * 90, None, 1003)]
    df = spark.createDataFrame(rows, "location string, timestamp timestamp_ntz, v double, i long").repartition(3)
    for spans in (1, 2, 7, 64):
        fill = {x["i"]: x["v"] for x in timeseries.forward_fill(df, "v", spans=spans, ties=["i"]).collect()}
        idx = {x["i"]: x["time_idx"] for x in timeseries.index_by_count(df, spans=spans, ties=["i"]).collect()}
        if spans == 1:
            want = fill, idx
        assert (fill, idx) == want
    assert timeseries.forward_fill(df, "v", spans=7).columns == df.columns
    assert timeseries.forward_fill(df.limit(0), "v", spans=7).count() == timeseries.index_by_count(df.limit(0), spans=7).count() == 0
    tasks = timeseries._in_spans(df.where("location = 'hot'"), "location", "timestamp", 32).repartition(16, "_k").select(F.spark_partition_id()).distinct().count()
    assert tasks > 8


def test_quantiles_of_hot_groups(spark):
    """Counts by bins corner the same quantiles as sorting, for groups of any size and shape."""
    r = np.random.default_rng(8)
    data = {"a": r.normal(size=3000), "b": r.exponential(size=2000) ** 4, "c": np.full(1500, 7.0), "d": np.r_[np.zeros(900), 1e300, -1e300, r.normal(size=700)], "e": r.normal(size=20), "f": np.array([])}
    rows = [(k, float(x), None if i % 5 == 0 else -2.0 * float(x), i) for k, v in data.items() for i, x in enumerate(v)] + [("f", None, None, 0), (None, 1.0, float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, i int").repartition(3)
    qs = (0.0, 0.05, 0.5, 0.9, 1.0)
    for hot, bins, few in ((100_000, 256, 4096), (100, 16, 4)):
        got = {x["g"]: x for x in aggregate.group_quantiles(df, ["g"], ["x", "y"], qs, [F.count("x").alias("n"), F.max("x").alias("m")], hot=hot, bins=bins, few=few).collect()}
        assert set(got) == {*data, None} and got[None]["q_x"] == [1.0] * 5 and got[None]["q_y"] == got["f"]["q_x"] == [None] * 5
        for k, v in data.items():
            y = -2.0 * v[[i for i in range(len(v)) if i % 5]] if len(v) else v
            for c, x in (("q_x", v), ("q_y", y)):
                assert got[k][c] == ([None] * 5 if not len(x) else pytest.approx(np.quantile(x, qs).tolist(), rel=1e-12))
            assert got[k]["n"] == len(v)
    plan = aggregate.site_quantiles(df.withColumnRenamed("g", "location"), ["x", "y"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_window_starts_by_arithmetic(spark):
    for n, size, step in ((10, 4, 3), (23, 5, 5), (17, 3, 7), (40, 12, 1), (4, 4, 2), (9, 8, 3)):
        got = {(x["i"], x["s"]) for x in spark.range(n).select(F.col("id").alias("i"), F.explode(timeseries.window_starts(F.col("id"), F.lit(n).cast("long"), size, step)).alias("s")).collect()}
        assert got == {(i, s) for s in range(0, n - size, step) for i in range(s, s + size)}


def classic_netcdf(version, dims, variables, records, fixed_time=False):
    """Bytes of a classic NetCDF file. dims: name -> length (0: records); variables: (name, dims, attributes, array)."""
    import struct

    n4 = lambda x: struct.pack(">i", x)
    count = (lambda x: struct.pack(">q", x)) if version == 5 else n4
    offset = n4 if version == 1 else lambda x: struct.pack(">q", x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: count(len(s.encode())) + pad(s.encode())
    kinds = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def attributes(a):
        out = n4(12 if a else 0) + count(len(a))
        for k, v in a.items():
            if isinstance(v, str):
                out += name(k) + n4(2) + count(len(v)) + pad(v.encode())
            else:
                out += name(k) + n4(kinds[v.dtype.str[1:]]) + count(v.size) + pad(v.astype(v.dtype.newbyteorder(">")).tobytes())
        return out

    ids = list(dims)
    is_record = lambda ds: bool(ds) and dims[ds[0]] == 0
    raw = {n: x.astype(x.dtype.newbyteorder(">")).tobytes() for n, _, _, x in variables}
    one = {n: len(raw[n]) // (records if is_record(ds) else 1) for n, ds, _, _ in variables}
    n_record = sum(is_record(ds) for _, ds, _, _ in variables)

    def build(begins):
        out = b"CDF" + bytes([version]) + count(records) + n4(10) + count(len(dims)) + b"".join(name(d) + count(n) for d, n in dims.items()) + attributes({"title": "x"}) + n4(11) + count(len(variables))
        for n, ds, a, x in variables:
            out += name(n) + count(len(ds)) + b"".join(count(ids.index(d)) for d in ds) + attributes(a) + n4(kinds[x.dtype.str[1:]]) + count(one[n] + -one[n] % 4) + offset(begins[n])
        return out

    at, begins = len(build(dict.fromkeys(one, 0))), {}
    body = b""
    for n, ds, _, _ in sorted(variables, key=lambda v: is_record(v[1])):
        if not is_record(ds):
            begins[n] = at + len(body)
            body += pad(raw[n])
    start = at + len(body)
    inner = 0
    for n, ds, _, _ in variables:
        if is_record(ds):
            begins[n] = start + inner
            inner += one[n] + (-one[n] % 4 if n_record > 1 else 0)
    for t in range(records):
        for n, ds, _, _ in variables:
            if is_record(ds):
                r = raw[n][t * one[n] : (t + 1) * one[n]]
                body += pad(r) if n_record > 1 else r
    return build(begins) + body


def test_netcdf(spark, tmp_path, monkeypatch):
    from gridloom.sources import netcdf

    r = np.random.default_rng(1)
    lat, lon = np.array([51.5, 51.25, 51.0], "f4"), np.array([-1.0, -0.75], "f4")
    want = {}
    for k, (version, fixed) in enumerate(((1, False), (2, True), (5, False))):
        n = 24 * 31
        hours = np.arange(n, dtype="i4") + 24 * 31 * k
        packed = r.integers(-300, 300, (n, 3, 2)).astype("i2")
        packed[5, 1, 1] = -999
        wind = r.normal(size=(n, 3, 2)).astype("f8")
        wind[7, 0, 0] = np.nan
        variables = [
            ("time", ("time",), {"units": "hours since 2021-01-01 00:00:00"}, hours), ("latitude", ("latitude",), {}, lat), ("longitude", ("longitude",), {}, lon),
            ("t2m", ("time", "latitude", "longitude"), {"scale_factor": np.array([0.5]), "add_offset": np.array([270.0]), "_FillValue": np.array([-999], "i2")}, packed),
        ] + ([("u10", ("time", "latitude", "longitude"), {}, wind)] if k < 2 else [])
        dims = {"longitude": 2, "time": n if fixed else 0, "latitude": 3}
        (tmp_path / f"w{k}.nc").write_bytes(classic_netcdf(version, dims, variables, n if not fixed else 0))
        for t in range(n):
            for i in range(3):
                for j in range(2):
                    temp = None if packed[t, i, j] == -999 else packed[t, i, j] * 0.5 + 270
                    u = None if k == 2 or np.isnan(wind[t, i, j]) else wind[t, i, j]
                    want[datetime(2021, 1, 1) + timedelta(hours=int(hours[t])), float(lat[i]), float(lon[j])] = (temp, u)
    df = netcdf.read_netcdf(spark, f"{tmp_path}/*.nc", ["t2m", "u10"], slabBytes=20_000)
    got = {(x["timestamp"], x["era5_lat"], x["era5_lon"]): (x["weather_t2m"], x["weather_u10"]) for x in df.collect()}
    assert got == want and df.rdd.getNumPartitions() > 20
    one_month = df.where((F.col("timestamp") >= F.lit("2021-02-01").cast("timestamp_ntz")) & (F.col("timestamp") < F.lit("2021-02-11").cast("timestamp_ntz")))
    assert one_month.count() == 240 * 6 and one_month.rdd.getNumPartitions() < df.rdd.getNumPartitions() / 5  # other slabs are not opened
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="not a classic"):
        netcdf.read_netcdf(spark, f"{tmp_path}/x.nc", ["t2m"]).count()
    with pytest.raises(Exception, match="no grid file"):
        netcdf.read_netcdf(spark, f"{tmp_path}/none*.nc", ["t2m"]).count()


def test_state_of_sites(spark, tmp_path):
    """Three runs over split input, each a restart from the checkpoint, give what one batch query over everything gives."""
    from gridloom.streaming import sites

    sites.with_state_store(spark)
    r = random.Random(4)
    rows = [(s, T0 + HALF * i, None if r.random() < 0.5 else float(r.randrange(100))) for s in ("a", "b", "c") for i in range(60) if s != "c" or i >= 40]
    (tmp_path / "in").mkdir()
    schema = "tx_id string, hh timestamp, kva double"
    for part in range(3):
        some = [x for x in rows if part * 20 <= (x[1] - T0) / HALF < part * 20 + 20]
        r.shuffle(some)
        lines = [f"{s},{t:%Y-%m-%d %H:%M:%S},{'' if v is None else v}" for s, t, v in some]
        (tmp_path / "in" / f"{part}.csv").write_text("\n".join(["tx_id,hh,kva", *lines, ",2021-06-01 00:00:00,9"]))
        new = lambda: stream.stream_readings(spark, str(tmp_path / "in"), schema)
        stream.ingest_available(sites.fill_forward(new()), f"{tmp_path}/filled", f"{tmp_path}/c1").awaitTermination()
        sites.run_facts(sites.site_facts(new()), f"{tmp_path}/facts", f"{tmp_path}/c2").awaitTermination()
    batch = spark.createDataFrame(rows, schema).withColumnsRenamed({"tx_id": "location", "hh": "timestamp"})
    whole = timeseries.index_by_count(timeseries.forward_fill(batch, "kva", out="filled"))
    want = {(x["location"], x["timestamp"]): (x["kva"], x["filled"], x["time_idx"]) for x in whole.collect()}
    got = {(x["tx_id"], x["hh"]): (x["kva"], x["filled"], x["time_idx"]) for x in spark.read.parquet(f"{tmp_path}/filled").collect()}
    assert got == want
    facts = {x["tx_id"]: x for x in sites.latest(spark.read.parquet(f"{tmp_path}/facts")).collect()}
    full = aggregate.completeness(batch, "location", "kva").collect()
    assert set(facts) == {x["location"] for x in full}  # the distinct sites
    for x in full:
        f, own = facts[x["location"]], [y for y in rows if y[0] == x["location"]]
        assert (f["total_points"], f["non_nan_points"], f["fraction_non_nan"]) == (x["total_points"], x["non_nan_points"], x["fraction_non_nan"])
        assert (f["first_hh"], f["last_hh"]) == (min(y[1] for y in own), max(y[1] for y in own)) and f["last_kva"] == [y[2] for y in own if y[2] is not None][-1]


def test_generated_weather(spark):
    """Moments of many draws, free and given, are those of the normal distribution; reruns agree."""
    from gridloom.operators import generate

    r = np.random.default_rng(7)
    mean, factor = np.array([3.0, -1.0, 10.0]), np.array([[2.0, 0, 0], [1.0, 0.5, 0], [-1.0, 0.3, 1.5]])
    x = mean + r.normal(size=(4000, 3)) @ factor.T
    rows = [("a", 6, 12, *map(float, v)) for v in x] + [("b", 1, 0, 1.0, 2.0, 3.0), ("b", 1, 0, float("nan"), 2.0, 3.0), ("a", 7, 12, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "location string, month int, hour int, p double, q double, s double")
    m = generate.conditional_moments(df, ["p", "q", "s"])
    one = {k.location: k for k in m.where("month < 7").collect()}
    assert one["a"]["n"] == 4000 and one["a"]["cov_p_s"] == pytest.approx(np.cov(x.T, ddof=0)[0, 2]) and one["b"]["n"] == 1
    asked = spark.createDataFrame([("a", 6, 12, 0.5), ("b", 1, 0, 1.5), ("z", 1, 1, 1.0), ("a", 6, 12, None)], "location string, month int, hour int, q double")
    cov, mu = np.cov(x.T, ddof=0), x.mean(0)
    free = generate.conditional_draws(m, asked.where("q < 1"), ["p", "q", "s"], 10_000)
    got = np.array([[v["p"], v["q"], v["s"]] for v in free.collect()])
    assert np.allclose(got.mean(0), mu, atol=0.12) and np.allclose(np.cov(got.T), cov, atol=0.25)
    assert sorted(map(tuple, free.collect())) == sorted(map(tuple, generate.conditional_draws(m, asked.where("q < 1"), ["p", "q", "s"], 10_000).collect()))
    given = generate.conditional_draws(m, asked, ["p", "q", "s"], 10_000, given=["q"])
    got = np.array([[v["p"], v["q"], v["s"]] for v in given.where("location = 'a'").collect()])
    rest, at = [0, 2], mu[[0, 2]] + cov[[0, 2], 1] / cov[1, 1] * (0.5 - mu[1])
    left = cov[np.ix_(rest, rest)] - np.outer(cov[rest, 1], cov[rest, 1]) / cov[1, 1]
    clipped = (got[:, rest] <= x[:, rest].min(0)) | (got[:, rest] >= x[:, rest].max(0))
    assert len(got) == 10_000 and (got[:, 1] == 0.5).all() and clipped.mean() < 0.05
    assert np.allclose(got[:, rest].mean(0), at, atol=0.12) and np.allclose(np.cov(got[:, rest].T), left, atol=0.25)
    assert {(v["p"], v["q"], v["s"]) for v in given.where("location = 'b'").collect()} == {(1.0, 1.5, 3.0)}  # a constant stays what it was
    assert given.where("location = 'z'").count() == 0


def test_boosting_with_patience(spark, monkeypatch):
    from gridloom import models, tables
    from gridloom.models import boost

    r = np.random.default_rng(3)
    rows = [(float(a), float(b), float(3 * (a > 0.5) + (b > 0.3) + r.normal() * 0.3), bool(i % 3 == 0)) for i, (a, b) in enumerate(r.random((600, 2)))]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, False), (0.1, 0.2, None, True)], "a double, b double, y double, v boolean")
    kept = len(tables._SETTLED.get(spark.sparkContext.applicationId, []))
    m = boost(df, ["a", "b"], "y", validation="v", most=60, depth=2, rate=0.5, patience=4)
    assert len(tables._SETTLED[spark.sparkContext.applicationId]) == kept + 1  # rounds replace each other
    assert len(m.errors) < 60 and len(m.trees) == int(np.argmin(m.errors)) + 1 == len(m.errors) - 4  # stops after four rounds without gain
    got = m.score(df).collect()
    held = [(x["y"] - x["y_hat"]) ** 2 for x in got if x["v"] and x["y"] is not None]
    assert math.sqrt(np.mean(held)) == pytest.approx(min(m.errors)) and min(m.errors) < 0.4
    assert [x["y_hat"] for x in got if x["a"] is None] == [None]
    import duckdb

    data = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b, _, _) in enumerate(rows))
    other = duckdb.connect().execute(f"SELECT {m.sql()} FROM (VALUES {data}) t(i, a, b) ORDER BY i").fetchall()
    assert [x[0] for x in other] == pytest.approx([x["y_hat"] for x in got[: len(rows)]])  # another engine repeats the model
    both = []
    for most in (10**6, 0):  # one expression, and Arrow batches
        monkeypatch.setattr(models, "MOST_LEAVES", most)
        odd = df.unionByName(spark.createDataFrame([(float("nan"), 0.4, None, False), (0.4, None, None, None)], df.schema))
        both.append([x["y_hat"] for x in m.score(odd).collect()])
        assert m.score(odd.limit(0)).collect() == []
    assert both[0] == both[1] and both[0][-1] is None and both[0][-2] is not None
    with pytest.raises(ValueError, match="validation"):
        boost(df.where("NOT v"), ["a", "b"], "y", validation="v")


def test_bounded_scoring(spark):
    """A model that looks back a few rows scores sites of any length a batch at a time, as with whole sites in memory."""
    from gridloom.models import StreamScorer

    seen = spark.sparkContext.accumulator(0)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return 4

    def predict(width, rows, context):
        seen.add(len(rows) - context)
        assert len(rows) <= 1000 + 3 and context <= 3
        return rows["x"].rolling(width, min_periods=1).mean().to_numpy()[context:]

    df = spark.range(60_000).select(F.when(F.col("id") < 50_000, "hot").when(F.col("id") < 59_000, F.concat(F.lit("s"), F.col("id") % 7)).alias("location"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("timestamp"), (F.xxhash64("id") % 100).cast("double").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = StreamScorer(load, predict, ("x",), 3).score(df)
        whole = GroupScorer(lambda p: p.sort_values("timestamp")["x"].rolling(4, min_periods=1).mean().reindex(p.index), ("x",)).score(df.withColumn("location", F.coalesce("location", F.lit("none"))))
        a = {(x["location"] or "none", x["timestamp"]): x["y_hat"] for x in got.collect()}
        assert a == pytest.approx({(x["location"], x["timestamp"]): x["y_hat"] for x in whole.collect()}) and seen.value == 60_000 and loads.value <= 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert StreamScorer(load, predict, ("x",), 3).score(df.limit(0)).count() == 0


def test_geojson_by_ranges(spark, tmp_path):
    """Cut anywhere, within strings and escapes too, a collection gives the features that one read of it gives."""
    r = random.Random(8)
    odd = ['a "quoted" {name}', "back\\", "\\\\\\", "[]{}", "é日", "", '{"type":"Feature"}', "\\\"{"]
    made = lambda i: {"type": "Feature", "id": i, "properties": {"NAME": odd[i % 8] + str(i), "n": i, "deep": {"a": [1, {"b": "}"}]}, "none": None}, "geometry": {"type": "Point", "coordinates": [i, -i]} if i % 3 else {"type": "Polygon", "coordinates": [[[0, 0], [i, 0], [i, 2], [0, 2], [0, 0]]]}}
    paths = []
    for k, n in enumerate((40, 0, 7)):
        doc = {"type": "FeatureCollection", "crs": {"properties": {"name": 'x"{'}}, "bbox": [0, 1, 2, 3], "features": [made(100 * k + i) for i in range(n)], "after": [{"type": "other"}]}
        paths.append(str(tmp_path / f"{k}.json"))
        Path(paths[-1]).write_text(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=k == 0))
    rows = lambda d: [(x["properties"]["NAME"], x["properties"]["n"], json.loads(x["properties"]["deep"]), x["properties"]["none"], x["kind"], json.loads(x["coordinates"])) for x in d.orderBy("pos").collect()]
    want = sum((rows(geojson.read_features(spark, p)) for p in paths), [])
    for split in (37, 501, 1 << 20):
        got = geojson.read_large_features(spark, paths, split)
        assert rows(got) == want and [x["pos"] for x in got.orderBy("pos").collect()] == list(range(47))
    same = lambda d: sorted(map(tuple, geojson.centroids(d, ["NAME"]).drop("pos").collect()))
    assert same(geojson.read_large_features(spark, paths[:1], 301)) == same(geojson.read_features(spark, paths[0]))
    assert geojson.read_large_features(spark, []).count() == 0


def test_settled_small(spark):
    """Counted while written: a hint for a small table, a merge beyond, and an empty table is no trap."""
    from gridloom.tables import settled_small

    base = spark.range(50).withColumnRenamed("id", "k")
    plan = lambda d: spark.range(10_000).withColumnRenamed("id", "k").join(d, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(settled_small(base)) and "strategy=merge" in plan(settled_small(base, rows=10))
    for none in (base.where("k < 0"), spark.createDataFrame([], "k long"), base.where("k < 0").groupBy("k").count()):
        assert settled_small(none).count() == 0


def test_ties_at_interpolated_bounds(spark):
    """Interpolation between equal values is rounded once, so a bound among ties holds the same rows as in SQL."""
    v = [float(i) / 10 for i in range(10)] + [7.53] * 4 + [10.0 + i for i in range(40)]
    df = spark.createDataFrame([("a", x) for x in v], "location string, score double")
    s = 0.2 * 53 - 10
    assert (1 - s) * 7.53 + s * 7.53 < 7.53 == math.fma(7.53, 1 - s, s * 7.53)
    for keys in (["location"], []):
        assert aggregate.score_pools(df, keys=keys).where("in_low").count() == 14
    for hot in (1_000_000, 10):
        assert aggregate.group_quantiles(df, ["location"], ["score"], (0.2,), hot=hot, bins=4, few=3).first()["q_score"] == [7.53]


def test_one_rounding(spark):
    r = np.random.default_rng(3)
    rows = [tuple(map(float, x)) for x in np.c_[r.normal(size=500), np.round(r.random(500), 2), r.normal(size=500) ** 3]] + [(1e306, 0.5, 1.0), (math.inf, 0.5, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", stats.fused(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()
    assert all(x["f"] == math.fma(x["a"], x["b"], x["c"]) for x in got)
    assert any(x["f"] != x["a"] * x["b"] + x["c"] for x in got)


def test_trimmed_calibration_keeps_ties(spark):
    """The 1st percentile falls between equal values of y: they are within it, as in SQL."""
    rows = [("a", 7.53, float(i)) for i in range(8)] + [("a", 9.0 + i / 10, 0.0) for i in range(16)]
    s = 0.01 * 23
    assert (1 - s) * 7.53 + s * 7.53 > 7.53 == math.fma(7.53, 1 - s, s * 7.53)
    got = one(capacity.calibration(spark.createDataFrame(rows, "location string, y double, x double"), "y", "x"))
    _, y, x = zip(*rows[:-1], strict=True)  # the largest is above the 99th percentile
    assert (got["slope"], got["intercept"]) == pytest.approx(tuple(np.polyfit(x, y, 1)))


def test_no_correlation_is_not_negative(spark):
    """A covariance of zero, which sums of doubles miss by their rounding, in either direction."""
    x = np.random.default_rng(2).integers(0, 97, 40) / 97
    rows = [(float(k), float(a), float(b), s * float(c)) for k in range(40) for s in (1, -1) for a, b, c in zip(np.roll(x, k), [5.0] * 40, [0.1 * k] * 40, strict=True)]
    rows = [(k, a + 0.1, c) for k, a, _, c in rows]
    got = spark.createDataFrame(rows, "k double, x double, y double").where("k > 0").groupBy("k").agg(
        stats.correlation(F.col("x"), F.col("y")).alias("r"), stats.orientation_negative(F.col("x"), F.col("y")).alias("n"), stats.orientation_all(F.col("x"), F.col("y")).alias("a")
    ).collect()
    assert len(got) == 39 and all(abs(r["r"]) < 1e-14 for r in got) and any(r["r"] < 0 for r in got)
    assert all((r["n"], r["a"]) == (1, 1) for r in got)


def test_merge_meets_cells_once(spark):
    """Power takes its cell before it meets weather: the same rows, and no product of weather and sites."""
    sites = [("a", 50.0), ("b", 50.0), ("b", 50.25), ("c", 50.25), ("d", None), (None, 50.0)]
    m = spark.createDataFrame([(s, y, y and y - 51.0, f"{s}{y}") for s, y in sites], "location string, era5_lat double, era5_lon double, station string")
    power = spark.createDataFrame([(s, T0 + HALF * k, float(k)) for s in ("a", "b", "c", "d", "e", None) for k in (0, 1, 1, 2, 9)], "location string, timestamp timestamp_ntz, kva double")
    w = spark.createDataFrame([(T0 + HALF * k, y, y - 51.0, 10.0 * k + i) for k in (0, 1, 2, 3) for i, y in enumerate((50.0, 50.0, 50.25))], "timestamp timestamp_ntz, era5_lat float, era5_lon float, weather_t double")
    want = joins.power_to_weather(power, joins.weather_to_sites(w, m))
    got = merge.combine(power, m, w)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    keys = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(keys) == 2 and "timestamp" in keys[0] and "location" in keys[1]


def test_geojson_files_hold_one_collection(spark, tmp_path):
    """With collections in several partitions, none lands behind another one in a file."""
    spark.range(300).select(F.col("id").alias("s_suppkey"), F.format_string("S%03d", "id").alias("s_name"), (F.col("id") % 7).cast("int").alias("s_nationkey")).repartition(3).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = file_queries.geojson_centroids(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["geo_name"], r["longitude"], r["latitude"]) for r in got) == [(f"S{i:03d}", i % 7 + 0.5, i % 50 + 1.0) for i in range(300)]


def test_merged_table_joins_by_time_or_site(spark):
    """No join of the query is by cell alone, which would repeat all weather for every site of a cell."""
    d = "/root/testdata/sf0.001"
    plan = queries.merged_table(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and all("timestamp" in x or "location" in x for x in joined)

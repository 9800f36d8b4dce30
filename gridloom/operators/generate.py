"""A generative weather sampler: draws from the normal distribution of each (site, month, hour), given some of the features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.operators.sampling import hash_number
from gridloom.tables import settled, small

KEYS = ("location", "month", "hour")


def calendar_keys(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({"month": F.month(ts), "hour": F.hour(ts)})


def conditional_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: n, mean_<a>, min_<a>, max_<a> and cov_<a>_<b> (population, in the order of ``features``) over rows with all
    features. Every one is a mergeable sum, so a hot key costs a row per task."""
    d = df
    for c in features:
        d = d.where(stats.finite(F.col(c).cast("double")))
    one = [f(c).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    two = [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(features) for b in features[i:]]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *one, *two)


def with_factor(moments: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add l_<i>_<j>, the Cholesky factor of the covariances in the order of ``features``, one column after the other. A feature
    that the ones before determine (up to a billionth of its variance) has a zero row from its own place on."""
    name = lambda a, b: f"cov_{a}_{b}" if f"cov_{a}_{b}" in moments.columns else f"cov_{b}_{a}"
    for j in range(len(features)):
        var = F.col(name(features[j], features[j]))
        left = var
        for k in range(j):
            left = left - F.col(f"l_{j}_{k}") ** 2
        moments = moments.withColumn(f"l_{j}_{j}", F.when(left > var * 1e-9, F.sqrt(left)).otherwise(F.lit(0.0)))
        for i in range(j + 1, len(features)):
            rest = F.col(name(features[i], features[j]))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            moments = moments.withColumn(f"l_{i}_{j}", F.when(F.col(f"l_{j}_{j}") > 0, rest / F.col(f"l_{j}_{j}")).otherwise(F.lit(0.0)))
    return moments


def normal(seed: int, *columns: str | Column) -> Column:
    """A standard normal variate made of the hash of seed and values (Box and Muller): any engine can repeat it."""
    u, v = ((hash_number(seed, F.lit(k), *columns) + 0.5) / F.lit(4294967296.0) for k in (1, 2))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def conditional_draws(moments: DataFrame, requests: DataFrame, features: Sequence[str], draws: int, *, given: Sequence[str] = (), keys: Sequence[str] = KEYS, seed: int = 42) -> DataFrame:
    """keys, draw (from 1) and all ``features``: ``draws`` rows for each request (keys, and values of the ``given`` features).

    With the given features first, the factor L of their order turns given values into the variates that would have made them
    (forward substitution); fresh variates for the others then make draws of exactly the conditional normal distribution:
    x = mean + L z. Drawn values are clipped to the key's observed bounds. Requests without known moments, or with a
    missing given value, have no row. Reruns agree; requests that agree in keys and given values draw the same.
    """
    order = [*given, *[c for c in features if c not in given]]
    m = settled(with_factor(moments, order))  # a row per key
    asked = requests.select(*keys, *[F.col(c).cast("double").alias(f"_g_{c}") for c in given])
    for c in given:
        asked = asked.where(F.col(f"_g_{c}").isNotNull())
    d = asked.join(small(m), list(keys)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for i, c in enumerate(order):
        mean = F.col(f"mean_{c}")
        for k in range(i):
            mean = mean + F.col(f"l_{i}_{k}") * F.col(f"_z_{k}")
        if c in given:
            z = F.when(F.col(f"l_{i}_{i}") > 0, (F.col(f"_g_{c}") - mean) / F.col(f"l_{i}_{i}")).otherwise(F.lit(0.0))
            d = d.withColumns({f"_z_{i}": z, f"_x_{c}": F.col(f"_g_{c}")})
        else:
            d = d.withColumn(f"_z_{i}", normal(seed + i, *keys, *[f"_g_{g}" for g in given], "draw"))
            d = d.withColumn(f"_x_{c}", stats.clip(mean + F.col(f"l_{i}_{i}") * F.col(f"_z_{i}"), F.col(f"min_{c}"), F.col(f"max_{c}")))
    return d.select(*keys, "draw", *[F.col(f"_x_{c}").alias(c) for c in features])

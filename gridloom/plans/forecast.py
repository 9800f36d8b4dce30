"""Model tables, splits and forecasts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.models import Scorer, SequenceModel
from gridloom.operators import clean, timeseries


def model_table(df: DataFrame, features: Sequence[str], target: str, ts: str = "timestamp", group: str = "location") -> DataFrame:
    """Key, time, target and the features that exist, naive UTC, with a running index per site."""
    d = clean.select_present(df, [group, ts, target, *features])
    return timeseries.index_by_count(clean.to_naive_utc(clean.to_text(clean.nan_to_null(d), group), ts), group, ts)


def train_val(df: DataFrame, train_end: Column, val_start: Column, val_end: Column, target: str, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows with a target up to train_end, and from val_start to val_end."""
    return timeseries.split_by_time(df.na.drop(subset=[target]), train_end, val_end, ts, val_start)


def slice_for_inference(df: DataFrame, sites: Sequence[str] | None, start: Column, end: Column, encoder: int, horizon: int, ts: str = "timestamp", group: str = "location") -> DataFrame:
    """Sites and the time span that their windows need; both filters reach the scan."""
    d = df if sites is None else df.where(F.col(group).isin(list(sites)))
    return timeseries.index_by_count(d.where(timeseries.warm_up(ts, start, end, encoder, horizon)), group, ts)


def tuning_slice(df: DataFrame, start: object, end: object, exclude: Sequence[str], columns: Sequence[str], ts: str = "timestamp", group: str = "location") -> DataFrame:
    """Closed time range without some sites (rows without a site stay), projected."""
    return clean.select_present(df.where(clean.between(ts, start, end) & clean.not_in(group, exclude)), columns)


def predict(df: DataFrame, scorer: Scorer, ts: str = "timestamp", group: str = "location", horizon: int = 1) -> DataFrame:
    """Predictions as rows: location, timestamp, horizon_step, y_hat. Row models predict their own row (step 1)."""
    y = scorer.score(df)
    return y.select(group, ts, F.lit(horizon).alias("horizon_step"), "y_hat")


def predict_windows(
    df: DataFrame, model: SequenceModel, encoder: int, horizon: int, *, target: str, index: str = "time_idx", ts: str = "timestamp", group: str = "location", step: int = 1
) -> DataFrame:
    """Forecasts of a model over sequences, as rows by (site, time, step): location, timestamp, horizon_step, y_hat.

    Every full window (``encoder`` values before, ``horizon`` known rows from) is scored at its first decoder step, every
    ``step``-th of a site. A model may give quantiles per step, of which the middle one counts. Steps without a timestamp
    are dropped.
    """
    table = df if index in df.columns else timeseries.index_by_count(df, group, ts, index)
    w = timeseries.sequences(table, target, encoder, horizon, group, ts).join(table.select(group, ts, index), [group, ts])
    w = w.where(F.pmod(F.col(index) - encoder, F.lit(step)) == 0)
    scored = model.score(w.select(group, index, "encoder"), horizon, "y_hat")
    if dict(scored.dtypes)["y_hat"].startswith("array<array"):
        scored = scored.withColumn("y_hat", F.transform("y_hat", middle))
    return timeseries.in_order(expand(scored.select(group, index, "y_hat"), table, ts, group, index), group, ts, "horizon_step")


def middle(quantiles: Column) -> Column:
    """The middle one of a step's quantiles (of an even number the upper one of the two); null for none."""
    return F.get(quantiles, F.floor(F.size(quantiles) / 2).cast("int"))


def expand(predictions: DataFrame, table: DataFrame, ts: str = "timestamp", group: str = "location", index: str = "time_idx") -> DataFrame:
    """Arrays of predictions per (site, first index) to rows with timestamps; steps without one are dropped."""
    rows = timeseries.explode_horizon(predictions).withColumn(index, F.col(index) + F.col("horizon_step") - 1)
    stamps = table.groupBy(group, index).agg(F.min(ts).alias(ts))
    return rows.join(stamps, [group, index]).where(F.col(ts).isNotNull()).select(group, ts, "horizon_step", "y_hat")

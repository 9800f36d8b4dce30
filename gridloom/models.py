"""Scorers: a model is anything that adds a prediction column to a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import trees
from gridloom.tables import Relay


class Scorer(Protocol):
    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame: ...
    @property
    def features(self) -> list[str]: ...


@dataclass(frozen=True)
class LinearScorer:
    """intercept + sum of coefficient * feature; missing features add nothing. Stays in generated code."""

    coefficients: Mapping[str, float]
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        y = F.lit(float(self.intercept))
        for c, w in self.coefficients.items():
            y = y + F.coalesce(F.col(c) * F.lit(float(w)), F.lit(0.0))
        return df.withColumn(out, y)


@dataclass(frozen=True)
class PipelineScorer:
    """A fitted ML pipeline whose first stage assembles the features."""

    model: PipelineModel
    used: tuple[str, ...]

    @property
    def features(self) -> list[str]:
        return list(self.used)

    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        return self.model.transform(df).drop("_features").withColumnRenamed("prediction", out)


@dataclass(frozen=True)
class GroupScorer:
    """Any Python model over a site's rows (one site per call, in time order)."""

    predict: Callable[[pd.DataFrame], pd.Series]
    used: tuple[str, ...]
    group: str = "location"

    @property
    def features(self) -> list[str]:
        return list(self.used)

    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        predict = self.predict

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(**{out: predict(pdf).astype(float)})

        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != out), f"`{out}` double"])
        return df.drop(out).groupBy(self.group).applyInPandas(run, schema)


class SequenceModel(Protocol):
    """Adds an array of ``horizon`` predictions (or of arrays of quantiles) to rows with an array ``encoder``."""

    def score(self, df: DataFrame, horizon: int, out: str = "y_hat") -> DataFrame: ...


@dataclass(frozen=True)
class DampedTrend:
    """Level and damped slope of the encoder: last + slope * (damp + damp**2 + ...). Stays in generated code.

    With ``spread``, three quantiles per step: the forecast less, as it is, and more that many of the encoder's ranges.
    """

    damp: float = 0.5
    spread: float | None = None

    def score(self, df: DataFrame, horizon: int, out: str = "y_hat") -> DataFrame:
        e, n = F.col("encoder"), F.size("encoder")
        last, slope = F.element_at(e, -1), (F.element_at(e, -1) - F.element_at(e, 1)) / F.greatest(n - 1, F.lit(1))
        gains = [sum(self.damp**k for k in range(1, h + 1)) for h in range(1, horizon + 1)]
        steps = [last + slope * F.lit(float(g)) for g in gains]
        if self.spread is not None:
            wide = (F.array_max(e) - F.array_min(e)) * F.lit(float(self.spread))
            steps = [F.array(y - wide, y, y + wide) for y in steps]
        return df.withColumn(out, F.array(*steps))


@dataclass(frozen=True)
class ArrayModel:
    """Any Python model over a batch of encoders: (rows, encoder) -> (rows, horizon), or (rows, horizon, quantiles)."""

    predict: Callable[[np.ndarray, int], np.ndarray]
    quantiles: bool = False

    def score(self, df: DataFrame, horizon: int, out: str = "y_hat") -> DataFrame:
        predict = self.predict

        @F.pandas_udf("array<array<double>>" if self.quantiles else "array<double>")
        def run(encoder: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(predict(np.stack(encoder.to_list()), horizon), float).tolist()) if len(encoder) else [])

        return df.withColumn(out, run("encoder"))


#: Leaves up to which a boosted model is one expression. The code of a larger one outgrows what the JVM compiles, then what it
#: takes in a method.
MOST_LEAVES = 128


@dataclass(frozen=True)
class BoostedScorer:
    """base + sum of weighted trees; ``errors``: validation RMSE after each round.

    A model of up to ``MOST_LEAVES`` leaves is one expression in generated code; a larger one goes over Arrow batches, a level
    of a tree at a time for all rows of a batch. Both add the same doubles in the same order. A row that lacks a feature
    has no prediction.
    """

    trees: tuple[tuple[float, trees.Node | trees.Leaf], ...]
    used: tuple[str, ...]
    base: float
    errors: tuple[float, ...] = ()

    @property
    def features(self) -> list[str]:
        return list(self.used)

    def sql(self) -> str:
        """The model in SQL that other engines read too."""
        name = lambda k: f"CAST({self.used[k]} AS DOUBLE)"
        whole = " AND ".join(f"{c} IS NOT NULL" for c in self.used)
        return f"CASE WHEN {whole} THEN CAST({self.base!r} AS DOUBLE) + {trees.ensemble_sql(list(self.trees), name)} END"

    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        if sum(trees.leaves(t) for _, t in self.trees) <= MOST_LEAVES:
            return df.withColumn(out, F.expr(self.sql()))
        flat, base = [(w, trees.flatten(t)) for w, t in self.trees], self.base

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(trees.predict_batch(flat, np.column_stack([c.to_numpy(float) for c in columns]), base))

        values = [F.col(f"`{c}`").cast("double") for c in self.used]
        whole = F.forall(F.array(*values), lambda v: v.isNotNull())
        return df.withColumn(out, F.when(whole, run(*values)))


def boost(
    df: DataFrame, features: Sequence[str], target: str, *, validation: str, most: int = 1000, depth: int = 6, rate: float = 0.05, patience: int = 50, seed: int = 42
) -> BoostedScorer:
    """Gradient boosting of squared error that stops after ``patience`` rounds without a lower validation error and keeps the
    rounds up to the best one. ``validation``: a boolean column; its rows are not learnt from.

    A round fits one of Spark's regression trees to the residuals, and one job then writes the residuals after ``rate`` times
    that tree and sums up the validation error on the way; the table of the round before is deleted. So neither plans nor
    losses of executors grow with the number of rounds. Rows without a feature or target are left out. Without validation
    rows, or with no row to learn from, an error is raised.
    """
    rows = df.na.drop(subset=[*features, target]).select(*features, F.col(target).cast("double").alias("_r"), F.coalesce(F.col(validation), F.lit(False)).alias("_v"))
    relay, vector = Relay(), VectorAssembler(inputCols=list(features), outputCol="_x")
    rows, n = relay.next(rows, F.count_if(~F.col("_v")).alias("learn"), F.count_if("_v").alias("check"), F.avg(F.when(~F.col("_v"), F.col("_r"))).alias("base"))
    if not n["learn"] or not n["check"]:
        raise ValueError("boosting with patience needs rows to learn from and validation rows")
    base, found, errors, best = float(n["base"]), [], [], 0
    rows = rows.withColumn("_r", F.col("_r") - F.lit(base))
    for k in range(1, most + 1):
        seen = vector.transform(rows)
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_r", predictionCol="_p", maxDepth=depth, seed=seed).fit(seen.where("NOT _v"))
        found.append((rate, trees.single(tree.toDebugString)))
        after = tree.transform(seen).withColumn("_r", F.col("_r") - F.lit(rate) * F.col("_p")).drop("_x", "_p")
        rows, n = relay.next(after, F.sqrt(F.avg(F.when(F.col("_v"), F.col("_r") ** 2))).alias("error"))
        errors.append(n["error"])
        best = k if k == 1 or errors[-1] < errors[best - 1] else best
        if k - best >= patience:
            break
    return BoostedScorer(tuple(found[:best]), tuple(features), base, tuple(errors))


@dataclass(frozen=True)
class StreamScorer:
    """Any Python model over sites of any length: rows pass in (site, time) order, a batch at a time.

    ``load`` makes the model, once in each Python worker. ``predict(model, rows, context)`` gets up to ``encoder`` earlier rows of
    the site (``context`` of them) and the rows to score, and returns a value for each of the latter. So a task holds one
    batch and ``encoder`` rows, never a site.
    """

    load: Callable[[], object]
    predict: Callable[[object, pd.DataFrame, int], Sequence[float]]
    used: tuple[str, ...]
    encoder: int
    name: str = "model"
    group: str = "location"
    ts: str = "timestamp"

    @property
    def features(self) -> list[str]:
        return list(self.used)

    def score(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        load, predict, encoder, group, key = self.load, self.predict, self.encoder, self.group, f"{self.name}-{uuid.uuid4().hex}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _LOADED:
                _LOADED.clear()  # one model at a time
                _LOADED[key] = load()
            model, site, held = _LOADED[key], None, None
            for b in batches:
                if not b.num_rows:
                    continue
                rows = b.to_pandas()
                code = rows[group].ne(rows[group].shift()) & ~(rows[group].isna() & rows[group].shift().isna())
                code.iloc[0] = True
                y = []
                for _, part in rows.groupby(code.cumsum(), sort=False):
                    mine = part[group].iloc[0]
                    same = held is not None and (mine == site or (pd.isna(mine) and pd.isna(site)))
                    seen = pd.concat([held, part]) if same and len(held) else part
                    context = len(seen) - len(part)
                    y.append(np.asarray(predict(model, seen, context), float))
                    site, held = mine, seen.tail(encoder)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(y), from_pandas=True)], [*b.schema.names, out])

        d = df.drop(out)
        order = d.repartition(group).sortWithinPartitions(group, F.col(self.ts).asc_nulls_last())
        return order.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField(out, T.DoubleType())]))


_LOADED: dict[str, object] = {}


def fit_boosting(
    df: DataFrame, features: Sequence[str], target: str, *, validation: str | None = None, trees: int = 1000, depth: int = 6, rate: float = 0.05, seed: int = 42
) -> PipelineScorer:
    """Spark's gradient-boosted trees, whose first tree is not scaled by ``rate``. With a boolean ``validation`` column they stop at
    the first round that gains under a hundredth, which may be the second; ``boost`` has patience."""
    tree = GBTRegressor(featuresCol="_features", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    if validation:
        tree = tree.setValidationIndicatorCol(validation)
    rows = df.na.drop(subset=[*features, target])
    return PipelineScorer(Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), tree]).fit(rows), tuple(features))


def importances(scorer: PipelineScorer, top: int = 20) -> list[tuple[str, float]]:
    """Features by importance, descending."""
    got = zip(scorer.used, scorer.model.stages[-1].featureImportances.toArray().tolist(), strict=True)
    return sorted(got, key=lambda x: (-x[1], x[0]))[:top]


def importance_table(spark: SparkSession, scorer: PipelineScorer, top: int = 20) -> DataFrame:
    """The same as a table: feature, importance."""
    return spark.createDataFrame(importances(scorer, top), "feature string, importance double").orderBy(F.desc("importance"), "feature")

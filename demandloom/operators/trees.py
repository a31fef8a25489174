"""Tree models pooled over all entities.

One MLlib ensemble learns the lag features of every series at once, with each series
scaled by its own mean, and all entities step forward together. This replaces a separate
model per entity, so figures differ from per-entity fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PredictionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm

LAGS, MIN_POINTS = 5, 10


def within(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


def forest(n_estimators: int = 100, max_depth: int = 10, min_samples_leaf: int = 1, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", numTrees=within("n_estimators", n_estimators, 10, 500),
        maxDepth=within("max_depth", max_depth, 1, 30), minInstancesPerNode=within("min_samples_leaf", min_samples_leaf, 1, 10), seed=seed,
    )


def boosting(n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.1, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="label", maxIter=within("n_estimators", n_estimators, 10, 1000),
        maxDepth=within("max_depth", max_depth, 1, 20), stepSize=within("learning_rate", learning_rate, 0.01, 1.0), seed=seed,
    )


def _scaled(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    scale = sm.let(sm.mean(F.col("ys")), lambda m: F.when(m > 0, m).otherwise(1.0))
    base = series.where(F.size("ys") >= MIN_POINTS).withColumn("scale", scale)
    return base.withColumn("zs", F.transform("ys", lambda y: y / F.col("scale")))


def _features(window: Column, t: Column, factors: Column | None) -> Column:
    x = F.concat(window, F.array(t.cast("double")))
    if factors is not None:
        x = F.concat(x, factors)
    return array_to_vector(x)


def fit_pooled(series: DataFrame, keys: Sequence[str], estimator, factors: str | None = None, partitions: int = 32) -> PredictionModel | None:
    """The ensemble fitted on all series of ``MIN_POINTS`` points or more; None if there are none.

    The rows lie in a fixed number of partitions, by key, in key and time order: random draws of the
    learner then do not depend on the cluster. Give more partitions for more series.
    """
    fx = F.col(factors) if factors else None
    rows = _scaled(series, keys).select(*keys, F.posexplode(sm.lag_rows(F.col("zs"), LAGS, fx)).alias("t", "r"))
    rows = rows.repartition(partitions, *keys).sortWithinPartitions(*keys, "t")
    rows = rows.select(array_to_vector("r.x").alias("features"), F.col("r.y").alias("label"))
    return None if rows.isEmpty() else estimator.fit(rows)


def roll_pooled(model: PredictionModel | None, series: DataFrame, keys: Sequence[str], horizon: int, factors: str | None = None) -> DataFrame:
    """``horizon`` steps for every entity: the loop runs over steps, each step over all entities.

    Entities of fewer than ``MIN_POINTS`` points get their fitted line, which has no steps to learn from.
    The last known factor values stay. Each step ends in a one-element explode, which keeps
    the optimizer from folding the steps into each other and evaluating a prediction once per
    later use of it; all steps still run in one narrow stage.
    """
    line = series.where(F.size("ys") < MIN_POINTS).select(*keys, sm.linear(F.col("ys"), horizon).alias("forecast"))
    if model is None:
        return line
    kept = [*keys, "scale", "n", *(["fx"] if factors else [])]
    df = _scaled(series, keys).select(
        *keys, "scale", F.size("zs").alias("n"), *([F.element_at(factors, -1).alias("fx")] if factors else []),
        F.explode(
            F.array(
                F.struct(sm.tail(F.col("zs"), LAGS).alias("win"), F.array().cast("array<double>").alias("out"))
            )
        ).alias("s"),
    )
    for k in range(horizon):
        x = _features(F.col("s.win"), F.col("n") + k, F.col("fx") if factors else None)
        y = F.array(F.greatest(F.col("prediction"), F.lit(0.0)))
        state = F.struct(
            F.concat(F.slice("s.win", 2, LAGS), y).alias("win"), F.concat("s.out", y).alias("out")
        )
        df = model.transform(df.withColumn("features", x)).select(*kept, F.explode(F.array(state)).alias("s"))
    return df.select(*keys, F.transform("s.out", lambda y: y * F.col("scale")).alias("forecast")).unionByName(line)

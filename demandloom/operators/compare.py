"""Comparing the forecasts of an entity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_fields(identifier: Column, level: Column) -> Column:
    """``a-b`` level and ``x-y`` identifier to a map; NULL when the counts differ."""
    names, values = F.transform(F.split(level, "-"), F.trim), F.split(identifier, "-")
    return F.when(F.size(names) == F.size(values), F.map_from_arrays(names, values))


def common_dates(points: DataFrame, keys: Sequence[str], run: str, date: str, runs: Sequence[str]) -> DataFrame:
    """Dates every listed run of an entity has."""
    seen = points.where(F.col(run).isin(list(runs))).groupBy(*keys, date).agg(F.collect_set(run).alias("_r"))
    return seen.where(F.size("_r") == len(set(runs))).select(*keys, date)


def missing_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that match nothing."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def side_by_side(points: DataFrame, keys: Sequence[str], run: str, date: str, value: str, runs: Sequence[str]) -> DataFrame:
    """One row per entity and date with the value of each requested run in ``v0..``.

    The request lists the runs, so they become columns and no self-join is needed.
    """
    return points.groupBy(*keys, date).agg(
        *[F.max(F.when(F.col(run) == r, F.col(value))).alias(f"v{i}") for i, r in enumerate(runs)]
    )


def aligned_pairs(wide: DataFrame, keys: Sequence[str], date: str, runs: Sequence[str], common: bool = True) -> DataFrame:
    """Rows (run_a, run_b, value_a, value_b) of every requested pair, on dates all runs share."""
    rows = wide
    if common:
        for i in range(len(runs)):
            rows = rows.where(F.col(f"v{i}").isNotNull())
    pairs = F.array(
        *[
            F.struct(
                F.lit(runs[a]).alias("run_a"), F.lit(runs[b]).alias("run_b"), F.col(f"v{a}").alias("value_a"), F.col(f"v{b}").alias("value_b")
            )
            for a, b in combinations(range(len(runs)), 2)
        ]
    )
    return rows.select(*keys, date, F.explode(pairs).alias("p")).select(*keys, date, "p.*")


def pair_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference, correlation and error of each pair."""
    d = F.col("value_b") - F.col("value_a")
    out = pairs.groupBy(*keys, "run_a", "run_b").agg(
        F.avg(d).alias("diff"), F.avg(F.abs(d)).alias("abs_diff"), F.avg("value_a").alias("mean_a"),
        F.corr("value_a", "value_b").alias("corr"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("comparison_points"),
    )
    pct = F.coalesce(F.try_divide("diff", "mean_a") * 100, F.lit(0.0))
    corr = F.when(F.col("comparison_points") > 1, F.col("corr")).otherwise(1.0)
    return out.select(
        *keys, "run_a", "run_b", F.round("diff", 2).alias("average_difference"), F.round("abs_diff", 2).alias("average_absolute_difference"),
        F.round(pct, 2).alias("percentage_difference"), F.round(corr, 4).alias("correlation"), F.round("rmse", 2).alias("rmse"), "comparison_points",
    )


def forecast_name(version: Column, algorithm: Column, factors: Column) -> Column:
    """``Version - Algorithm (with n factors)``."""
    base = F.concat(version, F.lit(" - "), F.coalesce(algorithm, F.lit("Unknown")))
    n = F.size(factors)
    return F.when(n > 0, F.concat(base, F.lit(" (with "), n.cast("string"), F.lit(" factors)"))).otherwise(base)

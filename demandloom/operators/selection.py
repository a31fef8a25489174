"""Evaluating, ranking and blending models for all entities in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.arima import arima, auto_sarima
from demandloom.functions.regression import consensus_slope, factor_line
from demandloom.functions.scalars import add_periods, let, steady_round
from demandloom.operators.series import parameter_grid
from demandloom.operators.totals import first_rows

# Metrics where more is better.
HIGHER_IS_BETTER = {"accuracy", "mae_accuracy", "rmse_accuracy"}
MODELS = sm.MODELS | {
    "linear_factors": factor_line, "arima_order": arima, "auto_sarima": auto_sarima,
    "consensus_polynomial": lambda ys, h, degree=2: sm.polynomial(ys, h, degree, consensus_slope),
}
# Models that take factor values next to the series.
WITH_FACTORS = {"linear_factors", "knn"}
METRICS = ["mae", "rmse", "mape", "accuracy", "mae_accuracy", "rmse_accuracy"]
# The largest values that two generations of the result table could hold, for callers that must fit one.
RESULT_BOUND, LEGACY_RESULT_BOUND = 999999.9999, 99999999.999999


def evaluate(
    series: DataFrame, keys: Sequence[str], models: Sequence[str], horizon: int, ratio: float = 0.8, options: dict | None = None, factors: str | None = None, future: str | None = None,
) -> DataFrame:
    """Every model on every series: scored on the held-back tail, refitted on the whole.

    Output: one row per entity and model with ``test_forecast``, ``test_actual``,
    ``test_periods``, ``forecast`` and the metric columns, next to ``fallback``, the simple
    moving average of the whole series. Both fits of a series are rows of one narrow stage
    (train part and whole), so the stage holds each model once and nothing is shuffled. A
    series under four points holds nothing back: its models have no score, and rank behind
    any model that has one.

    ``factors`` names a column with a row of factor values for each period; the models in ``WITH_FACTORS``
    learn from it. ``future`` names one with the values of the coming periods; then the held-back
    periods are scored with their own factor values. Without it the last known values stay in both runs.
    """
    options = options or {}
    given = {"fx": factors} | ({"fut": future} if future else {}) if factors else {}

    def results(train: Column, whole: Column, held: Column) -> Column:
        kept = {"fx": lambda c: sm.head(F.col(c), F.col("cut")), "fut": lambda _: F.slice(factors, F.col("cut") + 1, F.greatest(held, F.lit(1)))}
        runs = F.array(
            F.struct(train.alias("v"), F.greatest(held, F.lit(1)).alias("h"), *[kept[x](c).alias(x) for x, c in given.items()]),
            F.struct(whole.alias("v"), F.lit(horizon).alias("h"), *[F.col(c).alias(x) for x, c in given.items()]),
        )

        def both_runs(name: str) -> Column:
            extra = lambda r: {"factors": r["fx"], "future": r["fut"] if future else None} if given and name in WITH_FACTORS else {}
            return F.transform(runs, lambda r: MODELS[name](r["v"], r["h"], **options.get(name, {}), **extra(r)))

        return F.array(*[F.struct(F.lit(m).alias("algorithm"), both_runs(m).alias("f")) for m in models])

    base = series.select(*keys, "periods", "ys", *given.values(), F.size("ys").alias("n"), sm.train_length(F.size("ys"), ratio).alias("cut"))
    held = F.col("n") - F.col("cut")
    made = base.withColumn("fallback", sm.MODELS["simple_moving_average"](F.col("ys"), F.lit(horizon)))
    made = made.withColumn("m", F.explode(results(sm.head(F.col("ys"), F.col("cut")), F.col("ys"), held)))
    return _scored(made, keys, F.col("m.algorithm"), F.element_at("m.f", 1), F.element_at("m.f", 2))


def _scored(made: DataFrame, keys: Sequence[str], name: Column, on_train: Column, on_whole: Column) -> DataFrame:
    """The columns of an evaluation, from both forecasts of a model next to the series."""
    held = F.col("n") - F.col("cut")
    tail = lambda c: F.when(held > 0, F.slice(c, F.col("cut") + 1, F.greatest(held, F.lit(1))))
    made_test = F.when(held > 0, on_train)
    return made.select(
        *keys, name.alias("algorithm"), "n", "fallback", held.alias("test_periods"), tail("periods").alias("test_dates"),
        tail("ys").alias("test_actual"), made_test.alias("test_forecast"), on_whole.alias("forecast"),
        sm.score(tail("ys"), made_test).alias("metrics"),
    ).select("*", "metrics.*").drop("metrics")


def evaluate_fitted(
    series: DataFrame, keys: Sequence[str], models: dict[str, Callable[[DataFrame, list[str]], DataFrame]], horizon: int, ratio: float = 0.8
) -> DataFrame:
    """The rows of ``evaluate`` for models that are fitted as frames, not as expressions.

    A model takes (runs, keys), where runs has keys, ``ys`` and the number of steps ``h``, and gives keys
    and ``forecast``. The train part and the whole of every series are runs side by side, so one
    fit serves both and all entities. ``series`` is read once for each model and should be stored.
    """
    own = [*keys, "run_"]
    base = series.select(*keys, "periods", "ys", F.size("ys").alias("n"), sm.train_length(F.size("ys"), ratio).alias("cut"))
    steps = F.greatest(F.col("n") - F.col("cut"), F.lit(1))
    both = F.array(
        F.struct(F.lit("train").alias("run_"), sm.head(F.col("ys"), F.col("cut")).alias("ys"), steps.alias("h")),
        F.struct(F.lit("whole").alias("run_"), F.col("ys").alias("ys"), F.lit(horizon).alias("h")),
    )
    runs = base.select(*keys, F.explode(both).alias("r")).select(*keys, "r.*")
    base = base.withColumn("fallback", sm.MODELS["simple_moving_average"](F.col("ys"), F.lit(horizon)))
    out = None
    for name, model in models.items():
        pick = lambda run: F.max_by("forecast", F.col("run_") == run)
        both_made = model(runs, own).groupBy(*keys).agg(pick("train").alias("on_train"), pick("whole").alias("on_whole"))
        part = _scored(base.join(both_made, list(keys)), keys, F.lit(name), F.col("on_train"), F.col("on_whole"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_grid(series: DataFrame, keys: Sequence[str], grids: Mapping[str, Mapping[str, Any]], horizon: int, ratio: float = 0.8) -> DataFrame:
    """``evaluate`` for every model over every combination of its own parameter lists, in one plan.

    ``grids`` maps a model to its parameters as ``parameter_grid`` takes them: lists under ``name_list``, constants
    under their name. Parameters are columns of the result, null where a model has none of that name.
    """
    out, kinds = None, {}
    parts = []
    for model, params in grids.items():
        names = [p.removesuffix("_list") for p in params]
        grid = parameter_grid(series, params)
        kinds |= {n: grid.schema[n].dataType for n in names}
        parts.append(evaluate(grid, [*keys, *names], [model], horizon, ratio, {model: {n: F.col(n) for n in names}}))
    for part in parts:
        part = part.withColumns({n: F.lit(None).cast(t) for n, t in kinds.items() if n not in part.columns})
        out = part if out is None else out.unionByName(part)
    return out


def usable(forecast: Column) -> Column:
    """Whether there is a forecast and all of it is finite."""
    finite = F.forall(forecast, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(forecast) > 0) & finite, F.lit(False))


def succeeded(scored: DataFrame) -> DataFrame:
    """Drop failures before ranking: no forecast, or one that is not finite, means no rank."""
    return scored.where(usable(F.col("forecast")))


def direction(metric: str) -> Column:
    c = F.col(metric)
    return c.desc_nulls_last() if metric in HIGHER_IS_BETTER else c.asc_nulls_last()


def best_parameters(scored: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Highest accuracy per entity; on ties the parameter set that came first."""
    return first_rows(succeeded(scored), keys, [F.col("accuracy").desc_nulls_last(), *[F.col(c) for c in order]])


def best_fit(scored: DataFrame, keys: Sequence[str], metric: str | Column = "mape", top: int = 3) -> DataFrame:
    """Best model or the mean of the best three, per entity.

    ``metric`` is a name for all entities, or a column that names one for each entity, the same
    on all its rows. An entity has one entry per model, so its candidates fit one row; the
    ensemble and the final choice are expressions over that row. Models without a score come
    after all scored ones, by name, and take no part in an ensemble. An entity without any usable
    forecast gets its ``fallback``, where the rows have one, under the name of that model.
    """
    names = METRICS
    chosen = F.lit(metric) if isinstance(metric, str) else metric
    pick = lambda of: F.coalesce(*[F.when(F.col("metric") == m, of(m)) for m in names])
    sign = F.when(F.col("metric").isin(sorted(HIGHER_IS_BETTER)), -1.0).otherwise(1.0)
    rank = pick(lambda m: F.col(m)) * sign
    entry = F.struct(
        rank.isNull().alias("unranked"), rank.alias("rank_value"), F.col("algorithm").alias("algorithm"),
        F.col("forecast").alias("forecast"), F.col("test_forecast").alias("test_forecast"),
        *[F.col(c).alias(c) for c in names],
    )
    ok = usable(F.col("forecast"))
    if "fallback" not in scored.columns:
        scored = scored.withColumn("fallback", F.lit(None).cast("array<double>"))
    packed = scored.withColumn("metric", chosen).groupBy(*keys, "metric").agg(
        F.sort_array(F.collect_list(F.when(ok, entry))).alias("c"), F.first("fallback").alias("fallback")
    )

    def blend(rows: Column, field: str) -> Column:
        # As long as the best model's values; shorter ones drop out of later steps.
        return F.transform(
            F.get(rows, F.lit(0))[field],
            lambda _, i: sm.mean(
                F.array_compact(F.transform(F.filter(rows, lambda r: F.size(r[field]) > i), lambda r: F.get(r[field], i)))
            ),
        )

    def ensemble(rows: Column) -> Column:
        means = [sm.mean(rows[c]) for c in names]
        return F.struct(
            F.lit(False).alias("unranked"), (pick(lambda m: means[names.index(m)]) * sign).alias("rank_value"), F.lit("ensemble").alias("algorithm"),
            blend(rows, "forecast").alias("forecast"), blend(rows, "test_forecast").alias("test_forecast"),
            *[m.alias(c) for m, c in zip(means, names)],
        )

    def choose(c: Column) -> Column:
        best = F.get(c, F.lit(0))
        ranked = F.filter(c, lambda e: ~e["unranked"])
        blended = let(F.slice(ranked, 1, top), ensemble)
        return let(
            blended,
            lambda e: F.when((F.size(ranked) >= 2) & (e["rank_value"] < best["rank_value"]), e).otherwise(best),
        )

    choice = F.when(F.size("c") > 0, let(F.col("c"), choose))
    picked = packed.select(*keys, "metric", "fallback", choice.alias("b"), F.size("c").alias("candidates"))
    summary = F.when(F.col("metric") == "mape", 100.0 - F.col("b.mape")).when(F.col("metric") == "mae", F.col("b.mae_accuracy"))
    summary = summary.when(F.col("metric") == "rmse", F.col("b.rmse_accuracy")).otherwise(F.col("b.accuracy"))
    return picked.select(
        *keys, F.coalesce("b.algorithm", F.lit("simple_moving_average")).alias("selected_algorithm"), "candidates",
        "metric", summary.alias("summary_accuracy"), *[F.col(f"b.{c}").alias(c) for c in names],
        F.coalesce("b.forecast", "fallback").alias("forecast"), F.col("b.test_forecast").alias("test_forecast"),
    )


def published(c: Column, cap: float | None = None) -> Column:
    """Not below 0 and rounded to four digits; not above ``cap`` where the caller's table needs one."""
    floored = F.greatest(F.lit(0.0), c)
    return steady_round(floored if cap is None else F.least(F.lit(cap), floored), 4)


def flat_band(c: Column, pct: float = 0.1) -> tuple[Column, Column]:
    return steady_round(c * (1 - pct), 4), steady_round(c * (1 + pct), 4)


def result_rows(
    scored: DataFrame, keys: Sequence[str], start: str, metric: str | Column = "mape", cap: float | None = None, interval: str = "MONTHLY",
) -> DataFrame:
    """Long result rows: test actuals, test forecasts and future forecasts of each model.

    Future dates are ``start`` and the periods of ``interval`` after it. ``metric`` names the stored
    figure, for all rows or, as a column, for each.
    """
    name = F.lit(metric) if isinstance(metric, str) else metric
    figure = F.coalesce(*[F.when(name == m, F.col(m)) for m in METRICS])
    shared = [*keys, "algorithm"]
    zipped = F.arrays_zip(F.col("test_dates").alias("d"), F.col("test_actual").alias("a"), F.col("test_forecast").alias("f"))
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def entry(d, v, kind, acc, acc_name, lo, hi):
        return F.struct(
            d.alias("result_date"), v.alias("value"), F.lit(kind).alias("result_type"), acc.alias("accuracy_metric"),
            acc_name.alias("metric_type"), lo.alias("ci_lower"), hi.alias("ci_upper"),
        )

    actual = F.transform(zipped, lambda z: entry(z["d"], published(z["a"], cap), "testing_actual", none_d, none_s, none_d, none_d))
    test = F.transform(
        zipped,
        lambda z: entry(z["d"], published(z["f"], cap), "testing_forecast", figure, F.upper(name), none_d, none_d),
    )

    def ahead(v: Column, k: Column) -> Column:
        d = add_periods(F.lit(start).cast("date"), k, interval)
        return let(published(v, cap), lambda p: entry(d, p, "future_forecast", none_d, none_s, *flat_band(p)))

    future = F.transform("forecast", ahead)
    empty = F.filter(future, lambda _: F.lit(False))
    rows = F.concat(F.coalesce(actual, empty), F.coalesce(test, empty), F.coalesce(future, empty))
    return succeeded(scored).select(*shared, F.explode(rows).alias("r")).select(*shared, "r.*")


def best_mapping(results: DataFrame, keys: Sequence[str], mapping: str = "mapping_id", legacy_rank: bool = False) -> DataFrame:
    """Best mapping per run by its mean metric.

    The direction follows the stored metric's name. ``legacy_rank`` takes the highest figure
    whatever it measures.
    """
    scored = results.groupBy(*keys, mapping).agg(
        F.avg("accuracy_metric").alias("avg_metric"), F.max("metric_type").alias("metric_name")
    )
    up = F.lit(legacy_rank) | F.lower(F.col("metric_name")).isin(sorted(HIGHER_IS_BETTER))
    ranked = scored.withColumn("_v", F.when(up, F.col("avg_metric")).otherwise(-F.col("avg_metric")))
    return first_rows(ranked, keys, [F.col("_v").desc_nulls_last(), F.col(mapping)]).drop("_v")


def rows_of_best(results: DataFrame, run: str = "run_id", mapping: str = "mapping_id", legacy_rank: bool = False) -> DataFrame:
    """Result rows of each run's best mapping in one pass, so the results are computed once.

    A run holds as many rows as it has models and dates, so both windows stay small; they
    share one exchange on the run.
    """
    per_mapping, per_run = Window.partitionBy(run, mapping), Window.partitionBy(run)
    up = F.lit(legacy_rank) | F.lower(F.max("metric_type").over(per_mapping)).isin(sorted(HIGHER_IS_BETTER))
    avg = F.avg("accuracy_metric").over(per_mapping)
    ranked = results.repartition(run).withColumns({"avg_metric": avg, "_cost": F.when(up, -avg).otherwise(avg)})
    best = F.min(F.struct(F.col("_cost").isNull(), "_cost", mapping).alias("b")).over(per_run)
    return ranked.withColumn("_best", best[mapping]).where(F.col(mapping) == F.col("_best")).drop("_best", "_cost")

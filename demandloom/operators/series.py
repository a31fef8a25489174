"""Series preparation: one row per entity, profiles, metric choice, horizons, features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.scalars import add_periods, periods_between, period_start


def to_series(rows: DataFrame, keys: Sequence[str], date: str = "period", value: str = "total_quantity") -> DataFrame:
    """One row per entity with ``periods`` and ``ys`` in time order.

    The input is already one row per entity and period, so an array is as long as the
    calendar, whatever the entity's share of the facts. How many tasks share the entities is
    left to the session's shuffle partitions and AQE.
    """
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(date, value))).alias("_s"))
    return packed.select(
        *keys, F.col(f"_s.{date}").alias("periods"), F.col(f"_s.{value}").cast("array<double>").alias("ys"),
        F.size("_s").alias("n"),
    )


def fill_gaps(rows: DataFrame, keys: Sequence[str], interval: str = "MONTHLY", date: str = "period", value: str = "total_quantity") -> DataFrame:
    """Zero rows for the calendar periods an entity misses between its first and last one."""
    span = rows.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    k = F.explode(F.sequence(F.lit(0), periods_between(F.col("a"), F.col("b"), interval)))
    grid = span.withColumn("k", k).select(*keys, add_periods(F.col("a"), F.col("k"), interval).alias(date), "b")
    grid = grid.where(F.col(date) <= F.col("b")).drop("b")
    return grid.join(rows, [*keys, date], "left").fillna(0, subset=[value])


def profile(rows: DataFrame, keys: Sequence[str], value: str = "total_quantity") -> DataFrame:
    """Shape of each series. The rows are one per entity and period, so a window over an
    entity is as long as the calendar, and it shares the aggregation's partitioning."""
    y = F.col(value).cast("double")
    w = Window.partitionBy(*keys)
    marked = rows.where(y.isNotNull()).withColumns({"_m": F.avg(y).over(w), "_s": F.stddev_pop(y).over(w)})
    out_of_band = (F.col("_s") > 0) & (F.abs(y - F.col("_m")) > 3 * F.col("_s"))
    dev = y - F.col("_m")
    out = marked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min_value"),
        F.max(y).alias("max_value"), F.percentile(y, 0.5).alias("median"), F.count_if(y == 0).alias("zero_count"),
        F.count_if(out_of_band).alias("outlier_count"), F.avg(dev * dev * dev).alias("_m3"),
        F.avg(F.abs(dev)).alias("mean_abs_dev"),
    )
    std, n = F.col("std"), F.col("n")
    return out.select(
        *keys, "n", "mean", "std", "min_value", "max_value", "median", "zero_count",
        (F.col("zero_count") / n).alias("zero_ratio"),
        F.when(F.col("mean") > 0, std / F.col("mean")).otherwise(F.lit(float("inf"))).alias("cv"),
        F.when((std > 0) & (n >= 3), F.try_divide("_m3", std * std * std)).otherwise(0.0).alias("skewness"),
        "outlier_count", (F.col("outlier_count") / n).alias("outlier_ratio"), "mean_abs_dev",
    )


def outliers(rows: DataFrame, keys: Sequence[str], date: str = "period", value: str = "total_quantity") -> DataFrame:
    """Rows beyond three population deviations, with their position in the series."""
    every, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(date)
    y = F.col(value)
    marked = rows.select(
        *keys, date, value, (F.row_number().over(ordered) - 1).cast("bigint").alias("position"),
        F.avg(y).over(every).alias("_m"), F.stddev_pop(y).over(every).alias("_s"),
    )
    return marked.where((F.col("_s") > 0) & (F.abs(y - F.col("_m")) > 3 * F.col("_s"))).drop("_m", "_s")


def auto_metric(profiles: DataFrame) -> DataFrame:
    """Primary metric of each series from its profile; the first rule that holds decides."""
    mean, cv, skew, n = F.col("mean"), F.col("cv"), F.abs(F.col("skewness")), F.col("n")
    spiky = F.when(F.col("mean_abs_dev") > 0, F.col("std") / F.col("mean_abs_dev")).otherwise(1.0) > 1.5
    rmse_or_mae = F.when(spiky, "rmse").otherwise("mae")
    metric = (
        F.when((mean > 0) & (mean < 50) & (cv < 0.5), "mae")
        .when(F.col("zero_ratio") > 0.05, "mae")
        .when(F.col("outlier_ratio") > 0.10, rmse_or_mae)
        .when(cv > 1.0, rmse_or_mae)
        .when((cv > 0.5) & spiky, "rmse")
        .when((cv > 0.5) & (skew > 1.0), "mae")
        .when(n < 12, "mape")
        .when(skew > 1.5, "mae")
        .when(spiky, "rmse")
        .otherwise("mape")
    )
    return profiles.withColumn("primary_metric", metric)


def split_rows(rows: DataFrame, keys: Sequence[str], date: str = "period", ratio: float = 0.8) -> DataFrame:
    """Position of each row and whether it trains or tests."""
    ordered = Window.partitionBy(*keys).orderBy(date)
    t = (F.row_number().over(ordered) - 1).cast("bigint")
    n = F.count("*").over(Window.partitionBy(*keys))
    part = F.when(F.col("position") < sm.train_length(F.col("_n"), ratio), "train").otherwise("test")
    return rows.withColumns({"position": t, "_n": n}).withColumn("part", part).drop("_n")


def horizon(df: DataFrame, start: str, end: str, interval: str) -> DataFrame:
    """Horizon length of each row's date range, and its forecast dates one per row."""
    k = periods_between(F.col(start), F.col(end), interval)
    out = df.withColumn("horizon", k).where(F.col("horizon") > 0)
    out = out.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1)))
    return out.withColumn("forecast_date", add_periods(F.col(start), F.col("step"), interval))


def factor_interval(rows: DataFrame, key: str = "factor_name", date: str = "factor_date") -> DataFrame:
    """Frequency of each factor from the median gap between its dates."""
    w = Window.partitionBy(key).orderBy(date)
    gaps = rows.select(key, F.datediff(F.col(date), F.lag(date).over(w)).alias("gap"))
    gap = F.percentile("gap", 0.5)
    name = (
        F.when(F.col("median_gap") >= 300, "YEARLY").when(F.col("median_gap") >= 80, "QUARTERLY")
        .when(F.col("median_gap") >= 25, "MONTHLY").when(F.col("median_gap") >= 6, "WEEKLY").otherwise("DAILY")
    )
    return gaps.groupBy(key).agg(gap.alias("median_gap")).withColumn("interval", name)


FACTOR_POINTS = 3


def short_factors(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked factors that have too few points to be continued, with their number of points."""
    have = rows.groupBy("factor_name").agg(F.count("*").alias("points"))
    out = asked.select("factor_name").distinct().join(have, "factor_name", "left").fillna(0, ["points"])
    return out.where(F.col("points") < FACTOR_POINTS)


def extend_factors(rows: DataFrame, start: str, end: str, floor: bool = True) -> DataFrame:
    """Linear continuation of each factor over an inclusive date range at its own frequency.

    Factors with fewer than three points are left out; ``short_factors`` lists them.
    """
    series = to_series(rows, ["factor_name"], "factor_date", "factor_value").where(F.col("n") >= FACTOR_POINTS)
    freq = factor_interval(rows)
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    units = {"DAILY": "DAILY", "WEEKLY": "WEEKLY", "MONTHLY": "MONTHLY", "QUARTERLY": "QUARTERLY", "YEARLY": "YEARLY"}
    lengths, dates = F.lit(0), None
    for name in units:
        count = _inclusive_steps(a, b, name)
        lengths = F.when(F.col("interval") == name, count).otherwise(lengths)
    out = series.join(freq, "factor_name").withColumn("h", lengths).where(F.col("h") > 0)
    out = out.select("factor_name", "interval", F.posexplode(sm.linear(F.col("ys"), F.col("h"), floor)).alias("step", "factor_value"))
    for name in units:
        stepped = add_periods(a, F.col("step"), name)
        dates = F.when(F.col("interval") == name, stepped).otherwise(dates if dates is not None else F.lit(None).cast("date"))
    return out.select("factor_name", dates.alias("factor_date"), "factor_value", F.lit("Forecasted from historical data").alias("source"))


ANCHORS = ("first day", "last day", "first business day", "last business day")


def _anchor_day(month: Column, anchor: str) -> Column:
    """The anchored day of the month that ``month`` lies in."""
    if anchor.startswith("first"):
        day = F.trunc(month, "MM")
        return day if anchor == "first day" else F.date_add(day, F.when(F.weekday(day) > 4, 7 - F.weekday(day)).otherwise(0))
    day = F.last_day(month)
    return day if anchor == "last day" else F.date_sub(day, F.when(F.weekday(day) > 4, F.weekday(day) - 4).otherwise(0))


def _all_on(anchor: str) -> Column:
    return F.forall("d", lambda x: x == _anchor_day(x, anchor))


def _month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def factor_calendar(rows: DataFrame, key: str = "factor_name", date: str = "factor_date") -> DataFrame:
    """Interval of each factor and the calendar days its dates keep to, with its first and last date.

    From three dates on, ``anchor`` names what holds for all of them: every day, every business day, one
    weekday, or the first or last (business) day of months one, three or twelve apart. Where none holds
    it is NULL and the interval comes from the median gap, as in ``factor_interval``; one date is DAILY.
    NULL dates are left out and repeats count once. A factor's dates are as many as its calendar.
    """
    dates = rows.where(F.col(date).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(date)).alias("d"))
    d, n = F.col("d"), F.size("d")
    gaps = lambda f: F.transform(F.sequence(F.lit(1), n - 1), lambda i: f(F.get(d, i), F.get(d, i - 1)))
    dates = dates.withColumns({
        "days": F.when(n > 1, gaps(lambda x, y: F.datediff(x, y))),
        "steps": F.when(n > 1, gaps(lambda x, y: _month_number(x) - _month_number(y))),
    })
    all_gaps = lambda k: F.forall("days", lambda g: g == k)
    business = F.forall("d", lambda x: F.weekday(x) < 5) & F.forall(
        F.sequence(F.lit(1), n - 1), lambda i: F.get("days", i - 1) == F.when(F.weekday(F.get(d, i)) == 0, 3).otherwise(1)
    )
    step = F.get("steps", F.lit(0))
    even = F.forall("steps", lambda s: s == step) & step.isin(1, 3, 12)
    anchor = F.when(all_gaps(1), "day").when(business, "business day").when(all_gaps(7), "weekday")
    for name in ANCHORS:
        anchor = anchor.when(even & _all_on(name), name)
    out = dates.withColumn("anchor", F.when(n > 2, anchor))
    sorted_gaps = F.sort_array("days")
    low, high = F.get(sorted_gaps, F.floor((n - 2) / 2).cast("int")), F.get(sorted_gaps, F.floor((n - 1) / 2).cast("int"))
    gap = F.coalesce((low + high) / F.lit(2.0), F.lit(0.0))
    by_gap = F.when(gap >= 300, "YEARLY").when(gap >= 80, "QUARTERLY").when(gap >= 25, "MONTHLY").when(gap >= 6, "WEEKLY").otherwise("DAILY")
    by_step = F.when(step == 12, "YEARLY").when(step == 3, "QUARTERLY").otherwise("MONTHLY")
    by_anchor = F.when(F.col("anchor").isin("day", "business day"), "DAILY").when(F.col("anchor") == "weekday", "WEEKLY").otherwise(by_step)
    interval = F.when(F.col("anchor").isNull(), by_gap).otherwise(by_anchor)
    return out.select(key, interval.alias("interval"), "anchor", F.get(d, F.lit(0)).alias("first_date"), F.get(d, n - 1).alias("last_date"), n.alias("points"))


def calendar_dates(interval: Column, anchor: Column, last: Column, start: str, end: str) -> Column:
    """The dates in an inclusive range at which a factor goes on, given its calendar; NULL for an unanchored one.

    Weeks, quarters and years keep the phase of the factor's last date.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    none = F.expr("cast(array() as array<date>)")
    ordered = a <= b
    days = F.when(ordered, F.sequence(a, F.greatest(a, b), F.expr("interval 1 day"))).otherwise(none)
    firsts = F.when(ordered, F.sequence(F.trunc(a, "MM"), F.trunc(F.greatest(a, b), "MM"), F.expr("interval 1 month"))).otherwise(none)
    step = F.when(interval == "YEARLY", 12).when(interval == "QUARTERLY", 3).otherwise(1)
    due = F.filter(firsts, lambda m: F.pmod(_month_number(m) - _month_number(last), step) == 0)
    on_anchor = lambda name: F.transform(due, lambda m: _anchor_day(m, name))
    out = F.when(anchor == "day", days).when(anchor == "business day", F.filter(days, lambda x: F.weekday(x) < 5))
    out = out.when(anchor == "weekday", F.filter(days, lambda x: F.pmod(F.datediff(x, last), F.lit(7)) == 0))
    for name in ANCHORS:
        out = out.when(anchor == name, F.filter(on_anchor(name), lambda x: x.between(a, b)))
    return out


def continue_factors(rows: DataFrame, start: str, end: str, floor: bool = True) -> DataFrame:
    """Linear continuation of each factor on its own calendar days; without an anchor in steps from ``start``.

    The first date in the range takes the value after the last known one, as in ``extend_factors``. Factors
    with fewer than three points are left out.
    """
    series = to_series(rows, ["factor_name"], "factor_date", "factor_value").where(F.col("n") >= FACTOR_POINTS)
    out = series.join(factor_calendar(rows), "factor_name")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    dates = calendar_dates(F.col("interval"), F.col("anchor"), F.col("last_date"), start, end)
    stepped = lambda name, n: F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda k: add_periods(a, k, name))
    plain = None
    for name in ("DAILY", "WEEKLY", "MONTHLY", "QUARTERLY", "YEARLY"):
        count = F.greatest(_inclusive_steps(a, b, name), F.lit(0))
        steps = stepped(name, count)
        plain = F.when(F.col("interval") == name, steps) if plain is None else plain.when(F.col("interval") == name, steps)
    fitted = out.select("factor_name", "n", sm.line(F.col("ys")).alias("line"), F.coalesce(dates, plain).alias("dates"))
    # The outer form: for the inner one the optimizer tests the dates in a filter as well, and copies the calendar's expressions into it.
    fitted = fitted.select("factor_name", "n", "line", F.posexplode_outer("dates").alias("step", "factor_date")).where("factor_date IS NOT NULL")
    value = F.col("line.intercept") + F.col("line.slope") * (F.col("n") + F.col("step"))
    value = F.greatest(value, F.lit(0.0)) if floor else value
    return fitted.select("factor_name", "factor_date", value.alias("factor_value"), F.lit("Forecasted from historical data").alias("source"))


def _inclusive_steps(a: Column, b: Column, interval: str) -> Column:
    if interval == "DAILY":
        k = F.datediff(b, a) + 1
    elif interval == "WEEKLY":
        k = F.floor(F.datediff(b, a) / 7) + 1
    else:
        step = {"MONTHLY": 1, "QUARTERLY": 3, "YEARLY": 12}[interval]
        k = F.floor(F.months_between(b, a) / step) + 1
    return k.cast("int")


def factor_columns(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Columns that can serve as factors: not excluded, not dates, more than one value."""
    names = [f.name for f in df.schema.fields if f.name not in excluded and f.dataType.typeName() not in ("date", "timestamp", "timestamp_ntz")]
    # Two differing values are enough, so extremes settle it without a distinct shuffle.
    varied = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(False)).alias("usable")) for c in names])
    return varied.select(F.explode(pairs).alias("p")).select("p.column_name", "p.usable")


def first_seen_codes(values: Column) -> Column:
    """Text array to codes in order of first appearance; NULL is a value of its own."""
    filled = F.transform(values, lambda v: F.coalesce(v, F.lit("__MISSING__")))
    return sm.let(
        F.struct(filled.alias("v"), F.array_distinct(filled).alias("d")),
        lambda s: F.transform(s["v"], lambda v: (F.array_position(s["d"], v) - 1).cast("double")),
    )


def feature_rows(series: DataFrame, keys: Sequence[str], lags: int = 5, factors: Column | None = None) -> DataFrame:
    """Lag feature matrix: ``x`` holds lags oldest first, the index, then factor values."""
    rows = sm.lag_rows(F.col("ys"), lags, factors)
    return series.select(*keys, F.posexplode(rows).alias("row", "r")).select(
        *keys, (F.col("row") + lags).alias("t"), F.col("r.x").alias("x"), F.col("r.y").alias("y")
    )


def parameter_grid(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Each row once per parameter combination; ``*_list`` entries vary, others are constant."""
    out = df
    for name, value in params.items():
        if name.endswith("_list"):
            values = value if isinstance(value, (list, tuple)) else [value]
            out = out.withColumn(name[:-5], F.explode(F.array(*[F.lit(v) for v in values])))
        else:
            out = out.withColumn(name, F.lit(value))
    return out


def calendar(df: DataFrame, date: str, interval: str) -> DataFrame:
    return df.withColumn("period", period_start(F.col(date), interval))

"""Series scoring and forecast models over the monthly product series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.scalars import steady_round
from demandloom.operators import series as ops
from demandloom.operators import totals
from demandloom.plans import star
from demandloom.plans.registry import job
from demandloom.plans.totals import FACTOR_COLUMNS, PRIORITIES, monthly
from demandloom.plans.twins import add_view, with_views
from demandloom.session import cut_lineage

START, HORIZON = "2001-12-01", 12

add_view(
    "dp_idx",
    "SELECT product, period, total_quantity AS y, row_number() OVER (PARTITION BY product ORDER BY period) - 1 AS t, "
    "count(*) OVER (PARTITION BY product) AS n FROM dp_series",
    ["dp_series"],
)
# Master-level monthly cells: many, sparse and uneven, unlike the product series.
add_view(
    "dp_cells",
    "SELECT product, location, CAST(date_trunc('month', sale_date) AS DATE) AS period, sum(quantity) AS total_quantity "
    "FROM dp_flat GROUP BY ALL",
    ["dp_flat"],
)


def cells(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, ["product", "location", "sale_date", "quantity"])
    return totals.period_totals(flat, ["product", "location"], price=None)


CELL = ["product", "location"]

PROFILE_SQL = """
SELECT product, location, n, mean, std, min_value, max_value, median, zero_count, zero_count / n AS zero_ratio,
       CASE WHEN mean > 0 THEN std / mean ELSE CAST('inf' AS DOUBLE) END AS cv,
       CASE WHEN std > 0 AND n >= 3 THEN m3 / (std * std * std) ELSE 0 END AS skewness,
       outlier_count, outlier_count / n AS outlier_ratio, mean_abs_dev
FROM (SELECT product, location, count(*) AS n, any_value(m) AS mean, any_value(sd) AS std, min(y) AS min_value, max(y) AS max_value,
             quantile_cont(y, 0.5) AS median, count(*) FILTER (y = 0) AS zero_count,
             count(*) FILTER (sd > 0 AND abs(y - m) > 3 * sd) AS outlier_count,
             avg((y - m) * (y - m) * (y - m)) AS m3, avg(abs(y - m)) AS mean_abs_dev
      FROM (SELECT product, location, total_quantity AS y, avg(total_quantity) OVER (PARTITION BY product, location) AS m,
                   stddev_pop(total_quantity) OVER (PARTITION BY product, location) AS sd FROM dp_cells)
      GROUP BY product, location)"""
add_view("dp_profile", PROFILE_SQL, ["dp_cells"])

ROUNDED = ["mean", "std", "zero_ratio", "cv", "skewness", "outlier_ratio", "mean_abs_dev"]


@job(
    "t1_series_profile",
    with_views(
        "dp_profile",
        then="SELECT product, location, n, min_value, max_value, median, zero_count, outlier_count, "
        + ", ".join(f"floor({c} * 10000 + 0.500001) / 10000 AS {c}" for c in ROUNDED) + " FROM dp_profile",
    ),
)
def t1(spark, sf_dir):
    out = ops.profile(cells(spark, sf_dir), CELL)
    return out.withColumns({c: steady_round(F.col(c), 4) for c in ROUNDED})


@job(
    "t2_outliers",
    with_views(
        "dp_cells",
        then="""
SELECT product, location, period, total_quantity, position FROM (
  SELECT *, row_number() OVER (PARTITION BY product, location ORDER BY period) - 1 AS position,
         avg(total_quantity) OVER (PARTITION BY product, location) AS m,
         stddev_pop(total_quantity) OVER (PARTITION BY product, location) AS sd FROM dp_cells)
WHERE sd > 0 AND abs(total_quantity - m) > 3 * sd""",
    ),
)
def t2(spark, sf_dir):
    return ops.outliers(cells(spark, sf_dir).drop("transaction_count"), CELL)


@job(
    "t3_auto_metric",
    with_views(
        "dp_profile",
        then="""
SELECT product, location, CASE
  WHEN mean > 0 AND mean < 50 AND cv < 0.5 THEN 'mae'
  WHEN zero_ratio > 0.05 THEN 'mae'
  WHEN outlier_ratio > 0.10 THEN CASE WHEN r > 1.5 THEN 'rmse' ELSE 'mae' END
  WHEN cv > 1 THEN CASE WHEN r > 1.5 THEN 'rmse' ELSE 'mae' END
  WHEN cv > 0.5 AND r > 1.5 THEN 'rmse'
  WHEN cv > 0.5 AND abs(skewness) > 1 THEN 'mae'
  WHEN n < 12 THEN 'mape'
  WHEN abs(skewness) > 1.5 THEN 'mae'
  WHEN r > 1.5 THEN 'rmse' ELSE 'mape' END AS primary_metric
FROM (SELECT *, CASE WHEN mean_abs_dev > 0 THEN std / mean_abs_dev ELSE 1 END AS r FROM dp_profile)""",
    ),
)
def t3(spark, sf_dir):
    return ops.auto_metric(ops.profile(cells(spark, sf_dir), CELL)).select(*CELL, "primary_metric")


@job(
    "t4_metrics",
    with_views(
        "dp_idx",
        then="""
SELECT product, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(least(mape, 100), 2) AS mape,
       round(greatest(100 - round(least(mape, 100), 2), 0), 2) AS accuracy,
       CASE WHEN m > 0 THEN round(greatest(100 - mae / m * 100, 0), 2) ELSE 0 END AS mae_accuracy,
       CASE WHEN m > 0 THEN round(greatest(100 - rmse / m * 100, 0), 2) ELSE 0 END AS rmse_accuracy
FROM (SELECT product, avg(y) AS m, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
             coalesce(avg(abs((y - p) / y)) FILTER (y <> 0) * 100, 100) AS mape
      FROM (SELECT *, lag(y) OVER (PARTITION BY product ORDER BY t) AS p FROM dp_idx) WHERE p IS NOT NULL GROUP BY product)""",
    ),
)
def t4(spark, sf_dir):
    """Scores of last month's demand as the forecast of this month's."""
    s = ops.to_series(monthly(spark, sf_dir), ["product"]).where("n >= 2")
    rest = F.col("n") - 1
    scored = sm.score(F.slice("ys", F.lit(2), rest), F.slice("ys", F.lit(1), rest))
    return s.select("product", scored.alias("m")).select("product", "m.*")


@job(
    "t5_train_test_split",
    with_views(
        "dp_cells",
        then="""
SELECT product, location, period, total_quantity, position,
       CASE WHEN n < 4 OR position < least(greatest(2, floor(n * 0.8)), n - 1) THEN 'train' ELSE 'test' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY product, location ORDER BY period) - 1 AS position,
             count(*) OVER (PARTITION BY product, location) AS n FROM dp_cells)""",
    ),
)
def t5(spark, sf_dir):
    return ops.split_rows(cells(spark, sf_dir).drop("transaction_count"), CELL)


_SPAN = "SELECT customer, min(sale_date) AS first_date, max(sale_date) AS last_date FROM dp_flat GROUP BY customer"
_MONTHS = "(year(last_date) - year(first_date)) * 12 + month(last_date) - month(first_date)"
_H = {
    "WEEKLY": ("(last_date - first_date) // 7", "first_date + CAST(step * 7 AS INTEGER)"),
    "MONTHLY": (f"{_MONTHS} + 1", "CAST(first_date + to_months(CAST(step AS INTEGER)) AS DATE)"),
    "QUARTERLY": (f"({_MONTHS}) // 3 + 1", "CAST(first_date + to_months(CAST(step * 3 AS INTEGER)) AS DATE)"),
    "YEARLY": ("year(last_date) - year(first_date) + 1", "CAST(first_date + to_months(CAST(step * 12 AS INTEGER)) AS DATE)"),
}


@job(
    "t6_horizons",
    with_views(
        "dp_flat",
        then=" UNION ALL ".join(
            f"SELECT customer, '{i}' AS interval_name, horizon, step, {d} AS forecast_date FROM ("
            f"SELECT *, unnest(range(horizon)) AS step FROM (SELECT *, CAST({h} AS BIGINT) AS horizon FROM ({_SPAN})))"
            for i, (h, d) in _H.items()
        ),
    ),
)
def t6(spark, sf_dir):
    """Horizon and dates between each customer segment's first and last sale."""
    flat = star.sales_flat(spark, sf_dir, ["customer", "sale_date"])
    span = flat.groupBy("customer").agg(F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"))
    out = None
    for name in _H:
        part = ops.horizon(span, "first_date", "last_date", name).select(
            "customer", F.lit(name).alias("interval_name"), F.col("horizon").cast("bigint").alias("horizon"),
            F.col("step").cast("bigint").alias("step"), "forecast_date",
        )
        out = part if out is None else out.unionByName(part)
    return out


@job(
    "t7_factor_interval",
    with_views(
        "dp_factors",
        then="""
, g AS (SELECT factor_name, factor_date - lag(factor_date) OVER (PARTITION BY factor_name ORDER BY factor_date) AS gap FROM dp_factors),
m AS (SELECT factor_name, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY factor_name)
SELECT *, CASE WHEN median_gap >= 300 THEN 'YEARLY' WHEN median_gap >= 80 THEN 'QUARTERLY' WHEN median_gap >= 25 THEN 'MONTHLY'
  WHEN median_gap >= 6 THEN 'WEEKLY' ELSE 'DAILY' END AS interval_name FROM m""",
    ),
)
def t7(spark, sf_dir):
    return ops.factor_interval(star.factors(spark, sf_dir)).withColumnRenamed("interval", "interval_name")


@job(
    "t8_factor_forecast",
    with_views(
        "dp_factors",
        then="""
, i AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY factor_date) - 1 AS t FROM dp_factors),
f AS (SELECT factor_name, regr_slope(factor_value, t) AS s, regr_intercept(factor_value, t) AS b, count(*) AS n FROM i GROUP BY factor_name HAVING count(*) >= 3),
new AS (SELECT factor_name, CAST(DATE '2001-06-15' + to_months(CAST(k AS INTEGER)) AS DATE) AS factor_date, round(greatest(b + s * (n + k), 0), 4) AS factor_value,
          'Forecasted from historical data' AS source FROM f, range(13) r(k))
SELECT * FROM new UNION ALL
SELECT factor_name, factor_date, round(factor_value, 4), 'orders' FROM dp_factors o
WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.factor_name = o.factor_name AND new.factor_date = o.factor_date)""",
    ),
)
def t8(spark, sf_dir):
    """Continuation of every factor, merged into the factor table."""
    from demandloom.operators.upsert import upsert

    known = star.factors(spark, sf_dir)
    new = ops.extend_factors(known, "2001-06-15", "2002-06-30")
    out = upsert(known.withColumn("source", F.lit("orders")), new, ["factor_name", "factor_date"])
    return out.withColumn("factor_value", F.round("factor_value", 4))


@job(
    "t8_failed_factors",
    with_views("dp_factors", then="SELECT factor_name, count(*) AS points FROM dp_factors WHERE factor_name < '3' AND factor_date < DATE '1995-03-01' OR factor_name >= '3' "
               "GROUP BY factor_name HAVING count(*) < 3 UNION ALL SELECT 'no such factor', 0"),
)
def t8_failed(spark, sf_dir):
    """Asked factors that cannot be continued, with the points they have; some histories are cut short here."""
    known = star.factors(spark, sf_dir)
    short = known.where((F.col("factor_name") >= "3") | (F.col("factor_date") < F.lit("1995-03-01").cast("date")))
    asked = known.select("factor_name").distinct().unionByName(spark.createDataFrame([("no such factor",)], "factor_name string"))
    return ops.short_factors(short, asked)


# Order values on calendars of several kinds; those of the fifteenth keep to no anchor.
add_view(
    "dp_dated_factors",
    """
SELECT x.n AS factor_name, x.d AS factor_date, floor(avg(o_totalprice) * 100.0 + 0.500001) / 100.0 AS factor_value FROM (
  SELECT o_totalprice, unnest([
    {'n': 'day', 'd': o}, {'n': 'business day', 'd': CASE WHEN isodow(o) < 6 THEN o END}, {'n': 'friday', 'd': o + CAST((12 - isodow(o)) % 7 AS INTEGER)},
    {'n': 'month end', 'd': last_day(o)}, {'n': 'first business day', 'd': f + CASE isodow(f) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END},
    {'n': 'quarter end', 'd': last_day(CAST(date_trunc('quarter', o) + INTERVAL 2 MONTH AS DATE))},
    {'n': 'year start', 'd': CAST(date_trunc('year', o) AS DATE)}, {'n': 'fifteenth', 'd': f + 14}]) AS x
  FROM (SELECT o_totalprice, CAST(o_orderdate AS DATE) AS o, CAST(date_trunc('month', o_orderdate) AS DATE) AS f FROM orders))
WHERE x.d IS NOT NULL GROUP BY x.n, x.d""",
)
add_view(
    "dp_factor_calendar",
    """
SELECT factor_name, CASE
    WHEN anchor IN ('day', 'business day') THEN 'DAILY' WHEN anchor = 'weekday' THEN 'WEEKLY'
    WHEN anchor IS NOT NULL THEN CASE step WHEN 12 THEN 'YEARLY' WHEN 3 THEN 'QUARTERLY' ELSE 'MONTHLY' END
    WHEN gap >= 300 THEN 'YEARLY' WHEN gap >= 80 THEN 'QUARTERLY' WHEN gap >= 25 THEN 'MONTHLY' WHEN gap >= 6 THEN 'WEEKLY' ELSE 'DAILY' END AS interval_name,
  anchor, first_date, last_date, points FROM (
  SELECT *, CASE WHEN points < 3 THEN NULL WHEN daily THEN 'day' WHEN business THEN 'business day' WHEN weekly THEN 'weekday'
      WHEN step = last_step AND step IN (1, 3, 12) THEN CASE WHEN fd THEN 'first day' WHEN ld THEN 'last day' WHEN fb THEN 'first business day' WHEN lb THEN 'last business day' END
    END AS anchor FROM (
    SELECT factor_name, CAST(count(*) AS INTEGER) AS points, min(d) AS first_date, max(d) AS last_date, coalesce(quantile_cont(d - p, 0.5), 0) AS gap,
      bool_and(d - p = 1) AS daily, bool_and(d - p = 7) AS weekly,
      bool_and(isodow(d) < 6) AND bool_and(d - p = CASE isodow(d) WHEN 1 THEN 3 ELSE 1 END) AS business,
      min(year(d) * 12 + month(d) - year(p) * 12 - month(p)) AS step, max(year(d) * 12 + month(d) - year(p) * 12 - month(p)) AS last_step,
      bool_and(d = f) AS fd, bool_and(d = l) AS ld, bool_and(d = f + CASE isodow(f) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS fb,
      bool_and(d = l - CASE isodow(l) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END) AS lb
    FROM (SELECT factor_name, factor_date AS d, lag(factor_date) OVER (PARTITION BY factor_name ORDER BY factor_date) AS p,
            CAST(date_trunc('month', factor_date) AS DATE) AS f, last_day(factor_date) AS l FROM dp_dated_factors) GROUP BY factor_name))""",
    ["dp_dated_factors"],
)


def dated_factors(spark, sf_dir):
    o = F.col("o_orderdate").cast("date")
    first, quarter = F.trunc(o, "MM"), F.last_day(F.add_months(F.trunc(o, "quarter"), 2))
    opening = F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(0))
    dates = {
        "day": o, "business day": F.when(F.weekday(o) < 5, o), "friday": F.date_add(o, F.pmod(4 - F.weekday(o), F.lit(7))), "month end": F.last_day(o),
        "first business day": opening, "quarter end": quarter, "year start": F.trunc(o, "year"), "fifteenth": F.date_add(first, 14),
    }
    each = F.array(*[F.struct(F.lit(n).alias("factor_name"), d.alias("factor_date")) for n, d in dates.items()])
    # Days first: the calendars then share out a row per day, not one per order.
    days = star.table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n"))
    rows = days.select("total", "n", F.explode(each).alias("x")).where("x.factor_date IS NOT NULL")
    return rows.groupBy("x.factor_name", "x.factor_date").agg(steady_round(F.sum("total") / F.sum("n"), 2).alias("factor_value"))


@job("t7_factor_calendar", with_views("dp_factor_calendar", then="SELECT * FROM dp_factor_calendar"))
def t7_calendar(spark, sf_dir):
    return ops.factor_calendar(dated_factors(spark, sf_dir)).withColumnRenamed("interval", "interval_name")


@job(
    "t8_calendar_forecast",
    with_views(
        "dp_factor_calendar",
        then="""
, days AS (SELECT CAST(x AS DATE) AS d, CAST(date_trunc('month', x) AS DATE) AS f, last_day(CAST(x AS DATE)) AS l
           FROM range(TIMESTAMP '2001-09-10', TIMESTAMP '2003-02-16', INTERVAL 1 DAY) r(x)),
due AS (
  SELECT factor_name, d FROM dp_factor_calendar, days WHERE CASE anchor
    WHEN 'day' THEN TRUE WHEN 'business day' THEN isodow(d) < 6 WHEN 'weekday' THEN (d - last_date) % 7 = 0
    ELSE (year(d) * 12 + month(d) - year(last_date) * 12 - month(last_date)) % (CASE interval_name WHEN 'YEARLY' THEN 12 WHEN 'QUARTERLY' THEN 3 ELSE 1 END) = 0
      AND CASE anchor WHEN 'first day' THEN d = f WHEN 'last day' THEN d = l WHEN 'first business day' THEN d = f + CASE isodow(f) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END
            ELSE d = l - CASE isodow(l) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END END END AND anchor IS NOT NULL
  UNION ALL SELECT factor_name, d FROM dp_factor_calendar, days WHERE anchor IS NULL AND CASE interval_name
    WHEN 'DAILY' THEN TRUE WHEN 'WEEKLY' THEN (d - DATE '2001-09-10') % 7 = 0
    ELSE day(d) = 10 AND (year(d) * 12 + month(d) - 2001 * 12 - 9) % (CASE interval_name WHEN 'YEARLY' THEN 12 WHEN 'QUARTERLY' THEN 3 ELSE 1 END) = 0 END),
i AS (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY factor_date) - 1 AS t FROM dp_dated_factors),
m AS (SELECT factor_name, regr_slope(factor_value, t) AS s, regr_intercept(factor_value, t) AS b, count(*) AS n FROM i GROUP BY factor_name HAVING count(*) >= 3)
SELECT factor_name, d AS factor_date, round(greatest(b + s * (n + row_number() OVER (PARTITION BY factor_name ORDER BY d) - 1), 0), 1) AS factor_value,
  'Forecasted from historical data' AS source FROM due JOIN m USING (factor_name)""",
    ),
)
def t8_calendar(spark, sf_dir):
    """Every factor continued on its own days: month ends on month ends, business days without weekends."""
    return ops.continue_factors(dated_factors(spark, sf_dir), "2001-09-10", "2003-02-15").withColumn("factor_value", F.round("factor_value", 1))


_WIDE = (
    "SELECT product, period, total_quantity, transaction_count, 1.0 AS constant_factor, "
    + ", ".join(f"max(CASE WHEN factor_name = '{p}' THEN factor_value END) AS {c}" for p, c in zip(PRIORITIES, FACTOR_COLUMNS))
    + " FROM dp_series LEFT JOIN dp_factors ON period = factor_date GROUP BY ALL"
)
_CANDIDATES = ["constant_factor", *FACTOR_COLUMNS]


def history_with_factors(spark, sf_dir):
    wide = totals.pivot_factors(star.factors(spark, sf_dir), PRIORITIES, FACTOR_COLUMNS)
    series = monthly(spark, sf_dir)
    return series.join(wide, series.period == wide.factor_date, "left").drop("factor_date").withColumn("constant_factor", F.lit(1.0))


@job(
    "t9_factor_columns",
    with_views(
        "dp_series", "dp_factors",
        then=f", wide AS ({_WIDE}) "
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) > 1 AS usable FROM wide" for c in _CANDIDATES),
    ),
)
def t9(spark, sf_dir):
    return ops.factor_columns(history_with_factors(spark, sf_dir), ["product", "period", "total_quantity", "transaction_count"])


@job(
    "t10_feature_matrix",
    with_views(
        "dp_series", "dp_factors",
        then=f""", wide AS ({_WIDE}),
w AS (SELECT *, row_number() OVER p - 1 AS t, {", ".join(f"lag(total_quantity, {i}) OVER p AS lag{i}" for i in range(1, 6))},
      CASE WHEN urgent > 150000 THEN 'hot' WHEN urgent > 100 THEN 'cool' END AS mood FROM wide WINDOW p AS (PARTITION BY product ORDER BY period)),
m AS (SELECT *, coalesce(mood, '__MISSING__') AS filled FROM w),
codes AS (SELECT product, filled, row_number() OVER (PARTITION BY product ORDER BY min(t)) - 1 AS code FROM m GROUP BY product, filled)
SELECT m.product, t, lag5, lag4, lag3, lag2, lag1, CAST(t AS DOUBLE) AS time_index, coalesce(urgent, 0) AS factor_value,
       CAST(code AS DOUBLE) AS factor_code, total_quantity AS y
FROM m JOIN codes ON m.product = codes.product AND m.filled = codes.filled WHERE t >= 5""",
    ),
)
def t10(spark, sf_dir):
    """Lags, index, a numeric factor (missing is 0) and a text factor coded by first appearance."""
    mood = F.when(F.col("urgent") > 150000, "hot").when(F.col("urgent") > 100, "cool")
    rows = history_with_factors(spark, sf_dir).withColumn("mood", mood)
    packed = rows.groupBy("product").agg(
        F.sort_array(F.collect_list(F.struct("period", "total_quantity", "urgent", "mood"))).alias("s")
    )
    numeric = F.transform(F.col("s.urgent"), lambda v: F.coalesce(v, F.lit(0.0)))
    both = F.zip_with(numeric, ops.first_seen_codes(F.col("s.mood")), lambda a, b: F.array(a, b))
    series = packed.select("product", F.col("s.total_quantity").alias("ys"), both.alias("fx"))
    x = ["lag5", "lag4", "lag3", "lag2", "lag1", "time_index", "factor_value", "factor_code"]
    return ops.feature_rows(series, ["product"], 5, F.col("fx")).select(
        "product", F.col("t").cast("bigint").alias("t"), *[F.get("x", i).alias(c) for i, c in enumerate(x)], "y"
    )


@job(
    "t11_parameter_grid",
    with_views(
        "dp_master",
        then="SELECT DISTINCT product, customer, 12 AS season_length, n_neighbors, alpha "
        "FROM dp_master, (VALUES (5), (7), (10)) a(n_neighbors), (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) b(alpha)",
    ),
)
def t11(spark, sf_dir):
    """Every entity once per parameter combination."""
    entities = totals.combinations_at(star.sales_flat(spark, sf_dir, ["product", "customer"]), ["product", "customer"])
    params = {"n_neighbors_list": [5, 7, 10], "alpha_list": [0.1, 0.3], "season_length": 12}
    return ops.parameter_grid(entities, params)


# ---------------------------------------------------------------- models


def product_series(spark, sf_dir):
    return ops.to_series(monthly(spark, sf_dir), ["product"])


def model_rows(spark, sf_dir, model):
    """Future rows of one model for every product."""
    made = product_series(spark, sf_dir).select("product", F.posexplode(model(F.col("ys"), HORIZON)).alias("k", "v"))
    return made.select(
        "product", F.col("k").cast("bigint").alias("step"),
        F.add_months(F.lit(START).cast("date"), F.col("k")).alias("forecast_date"), F.round("v", 4).alias("forecast"),
    )


_DATE = f"CAST(DATE '{START}' + to_months(CAST(k AS INTEGER)) AS DATE) AS forecast_date"
_STEPS = f"range({HORIZON}) r(k)"


@job(
    "m1_linear_trend",
    with_views(
        "dp_idx",
        then=f"""
, f AS (SELECT product, regr_slope(y, t) AS s, regr_intercept(y, t) AS b, count(*) AS n FROM dp_idx GROUP BY product)
SELECT product, k AS step, {_DATE}, round(greatest(b + s * (n + k), 0), 4) AS forecast FROM f, {_STEPS}""",
    ),
)
def m1(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.linear)


@job(
    "m2_polynomial",
    with_views(
        "dp_idx",
        then=f"""
, z AS (SELECT *, t - (n - 1) / 2.0 AS z, CAST(n AS DOUBLE) * n AS n2 FROM dp_idx),
p AS (SELECT *, z * z - (n2 - 1) / 12.0 AS p2 FROM z),
c AS (SELECT product, any_value(n) AS n, any_value(n2) AS n2, avg(y) AS b0, sum(y * z) / sum(z * z) AS b1, sum(y * p2) / sum(p2 * p2) AS b2,
        max(y) AS hi, min(y) AS lo, avg(y) FILTER (t >= n - 12) AS recent, max(y) FILTER (t = n - 1) AS last_y FROM p GROUP BY product),
th AS (SELECT a.product, median((b.y - a.y) / (b.t - a.t)) AS trend FROM dp_idx a JOIN dp_idx b ON a.product = b.product AND a.t < b.t
       AND a.t >= a.n - 30 GROUP BY a.product),
x AS (SELECT c.*, trend, k, n + k - (n - 1) / 2.0 AS zz FROM c JOIN th USING (product), {_STEPS}),
y AS (SELECT *, b0 + b1 * zz + b2 * (zz * zz - (n2 - 1) / 12.0) AS pv, last_y + (k + 1) * trend AS tv FROM x)
SELECT product, k AS step, {_DATE}, round(greatest(0, least(least(recent * 1.8, hi * 1.3), greatest(greatest(recent * 0.5, lo * 0.6),
  CASE WHEN k < 3 THEN 0.6 * pv + 0.4 * tv WHEN k < 6 THEN 0.4 * pv + 0.6 * tv ELSE 0.2 * pv + 0.5 * tv + 0.3 * recent END))), 4) AS forecast
FROM y""",
    ),
)
def m2(spark, sf_dir):
    """Degree 2. The robust trend is the median of pairwise slopes, not a random-consensus fit."""
    return model_rows(spark, sf_dir, sm.polynomial)


@job(
    "m2_median_slope",
    with_views(
        "dp_idx",
        then="""
SELECT a.product, round(median((b.y - a.y) / (b.t - a.t)), 6) AS slope FROM dp_idx a JOIN dp_idx b ON a.product = b.product AND a.t < b.t
WHERE a.t >= a.n - 30 GROUP BY a.product""",
    ),
)
def m2_slope(spark, sf_dir):
    s = product_series(spark, sf_dir)
    return s.select("product", F.round(sm.middle_slope(sm.tail(F.col("ys"), 30)), 6).alias("slope"))


def _m3_sql(alphas: tuple[float, ...]) -> str:
    values = ", ".join(f"(CAST({a} AS DOUBLE), {i})" for i, a in enumerate(alphas))
    return with_views(
        "dp_idx", recursive=True,
        then=f"""
, al(alpha, pos) AS (VALUES {values}),
g AS (SELECT alpha, pos, list(power(1 - alpha, j) / s ORDER BY j) AS wt FROM (
        SELECT *, sum(power(1 - alpha, j)) OVER (PARTITION BY pos) AS s FROM al, range(5) r(j)) GROUP BY alpha, pos),
l AS (SELECT product, t, y, n, list(y) OVER (PARTITION BY product ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS win FROM dp_idx),
d AS (SELECT product, pos, t, y, list_dot_product(win, wt) AS s FROM l, g WHERE t >= 5),
c AS (SELECT product, pos, avg(s) AS ms, avg(t) AS mt, avg(y) AS my, var_pop(s) AS ss, var_pop(t) AS tt, covar_pop(s, t) AS st,
        covar_pop(y, s) AS sy, covar_pop(y, t) AS ty FROM d GROUP BY ALL),
b AS (SELECT *, (sy * tt - ty * st) / (ss * tt - st * st) AS bs, (ty * ss - sy * st) / (ss * tt - st * st) AS bt FROM c),
e AS (SELECT b.product, b.pos, any_value(bs) AS bs, any_value(bt) AS bt, any_value(my - bs * ms - bt * mt) AS b0,
        round(sqrt(avg(power(y - (my - bs * ms - bt * mt) - bs * s - bt * t, 2))), 2) AS rmse
      FROM b JOIN d ON b.product = d.product AND b.pos = d.pos GROUP BY ALL),
best AS (SELECT e.*, wt, row_number() OVER (PARTITION BY product ORDER BY rmse, e.pos) AS rn FROM e JOIN g ON e.pos = g.pos),
seed AS (SELECT b.product, bs, bt, b0, wt, max(n) AS n, list(y ORDER BY t) FILTER (t >= n - 5) AS win
         FROM best b JOIN dp_idx i ON b.product = i.product WHERE rn = 1 GROUP BY ALL),
roll AS (SELECT product, bs, bt, b0, wt, n, 0 AS k, win, greatest(b0 + bs * list_dot_product(win, wt) + bt * n, 0) AS v FROM seed
  UNION ALL
  SELECT product, bs, bt, b0, wt, n, k + 1, list_append(win[2:], v),
         greatest(b0 + bs * list_dot_product(list_append(win[2:], v), wt) + bt * (n + k + 1), 0) FROM roll WHERE k < {HORIZON - 1})
SELECT product, CAST(k AS BIGINT) AS step, {_DATE}, round(v, 4) AS forecast FROM roll""",
    )


@job("m3_smoothing_regression", _m3_sql(sm.DEFAULT_ALPHAS))
def m3(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.smoothing)


@job("m5_enhanced_smoothing", _m3_sql(sm.WIDE_ALPHAS))
def m5(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.MODELS["enhanced_exponential_smoothing"])


@job(
    "m4_simple_smoothing",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, s AS (SELECT product, t, n, y AS level FROM dp_idx WHERE t = 0
  UNION ALL SELECT i.product, i.t, i.n, 0.3 * i.y + 0.7 * s.level FROM s JOIN dp_idx i ON i.product = s.product AND i.t = s.t + 1)
SELECT product, k AS step, {_DATE}, round(level, 4) AS forecast FROM s, {_STEPS} WHERE t = n - 1""",
    ),
)
def m4(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.ses)


@job(
    "m6_holt_winters",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, base AS (SELECT product, any_value(n) AS n, avg(y) FILTER (t < 12) AS l0, (avg(y) FILTER (t >= 12 AND t < 24) - avg(y) FILTER (t < 12)) / 12 AS b0,
    stddev_pop(y) / avg(y) > 0.3 AND min(y) > 0 AS mult, avg(y) FILTER (t >= n - 12) AS recent, max(y) FILTER (t = n - 1) AS last_y,
    regr_slope(y, t) FILTER (t >= n - 12) AS slope FROM dp_idx GROUP BY product),
pm AS (SELECT i.product, t % 12 AS p, avg(y) AS m FROM dp_idx i WHERE t < (n // 12) * 12 GROUP BY ALL),
raw AS (SELECT pm.product, p, CASE WHEN mult THEN m / l0 ELSE m - l0 END AS s, mult FROM pm JOIN base USING (product)),
norm AS (SELECT product, list(CASE WHEN mult THEN s / a ELSE s - a END ORDER BY p) AS sea FROM (
    SELECT *, avg(s) OVER (PARTITION BY product) AS a FROM raw) GROUP BY product),
st AS (SELECT b.product, 0 AS t, l0 AS level, b0 AS trend, sea FROM base b JOIN norm USING (product)
  UNION ALL
  SELECT product, t, level, 0.1 * (level - old_level) + 0.9 * old_trend,
     list_transform(sea, lambda x, j: CASE WHEN j = t % 12 + 1 THEN 0.1 * (CASE WHEN mult THEN y / level ELSE y - level END) + 0.9 * x ELSE x END)
  FROM (SELECT st.product, i.t, i.y, b.mult, st.level AS old_level, st.trend AS old_trend, st.sea,
     0.3 * (CASE WHEN b.mult THEN i.y / st.sea[i.t % 12 + 1] ELSE i.y - st.sea[i.t % 12 + 1] END) + 0.7 * (st.level + st.trend) AS level
     FROM st JOIN dp_idx i ON i.product = st.product AND i.t = st.t + 1 JOIN base b ON b.product = st.product)),
f AS (SELECT b.*, level, trend, sea, k FROM st JOIN base b ON b.product = st.product AND st.t = b.n - 1, {_STEPS}),
v AS (SELECT *, CASE WHEN mult THEN (level + (k + 1) * trend) * sea[(n + k) % 12 + 1] ELSE level + (k + 1) * trend + sea[(n + k) % 12 + 1] END AS hw,
        last_y + (k + 1) * slope AS calm, greatest(0.4, 0.7 - 0.3 * k / {HORIZON - 1}) AS w FROM f)
SELECT product, k AS step, {_DATE}, round(greatest(0, least(recent * 1.6, greatest(recent * 0.5, hw * w + calm * (1 - w)))), 4) AS forecast FROM v""",
    ),
)
def m6(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.holt_winters)


_M7_SQL = with_views(
    "dp_idx", recursive=True,
    then=f"""
, seed AS (SELECT product, list(y ORDER BY t) FILTER (t >= n - 3) AS win, regr_slope(y, t) FILTER (t >= n - 6) AS s,
    greatest(min(y) * 0.5, 0) AS lo, max(y) * 1.5 AS hi FROM dp_idx GROUP BY product),
roll AS (SELECT product, s, lo, hi, 0 AS k, win, greatest(least(greatest(list_avg(win) + s, lo), hi), 0) AS v FROM seed
  UNION ALL
  SELECT product, s, lo, hi, k + 1, list_append(win[2:], v),
         greatest(least(greatest(list_avg(list_append(win[2:], v)) + s * power(0.95, k + 1), lo), hi), 0) FROM roll WHERE k < {HORIZON - 1})
SELECT product, CAST(k AS BIGINT) AS step, {_DATE}, round(v, 4) AS forecast FROM roll""",
)


@job("m7_moving_average", _M7_SQL)
def m7(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.moving_average)


@job("m8_simple_moving_average", _M7_SQL)
def m8(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.MODELS["simple_moving_average"])


@job(
    "m9_decomposition",
    with_views(
        "dp_idx",
        then=f"""
, tr AS (SELECT *, sum(y) OVER (PARTITION BY product ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12 AS trend FROM dp_idx),
sea AS (SELECT product, t % 12 AS p, avg(y - trend) AS s FROM tr GROUP BY ALL),
f AS (SELECT product, any_value(n) AS n, regr_slope(trend, t) AS a, regr_intercept(trend, t) AS b FROM tr GROUP BY product)
SELECT f.product, k AS step, {_DATE}, round(greatest(b + a * (n + k) + s, 0), 4) AS forecast
FROM f, {_STEPS}, sea WHERE sea.product = f.product AND sea.p = (n + k) % 12""",
    ),
)
def m9(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.decomposition)


@job(
    "m10_knn_one_step",
    with_views(
        "dp_idx",
        then=f"""
, l AS (SELECT product, t, n, y, {", ".join(f"lag(y, {i}) OVER w AS x{i}" for i in range(1, 6))}, CAST(t AS DOUBLE) AS x6
        FROM dp_idx WINDOW w AS (PARTITION BY product ORDER BY t)),
tr AS (SELECT *, {", ".join(f"avg(x{i}) OVER p AS m{i}, stddev_pop(x{i}) OVER p AS s{i}" for i in range(1, 7))} FROM l WHERE t >= 5
       WINDOW p AS (PARTITION BY product)),
q AS (SELECT product, any_value(n) AS n, {", ".join(f"max(y) FILTER (t = n - {i}) AS q{i}" for i in range(1, 6))}, CAST(any_value(n) AS DOUBLE) AS q6
      FROM dp_idx GROUP BY product),
d AS (SELECT tr.product, tr.y, row_number() OVER (PARTITION BY tr.product ORDER BY
      {" + ".join(f"power((x{i} - q{i}) / s{i}, 2)" for i in range(1, 7))}, t) AS rn FROM tr JOIN q ON tr.product = q.product)
SELECT product, round(greatest(avg(y), 0), 4) AS forecast FROM d WHERE rn <= 5 GROUP BY product""",
    ),
)
def m10_one(spark, sf_dir):
    s = product_series(spark, sf_dir)
    return s.select("product", F.round(F.get(sm.knn(F.col("ys"), 1), 0), 4).alias("forecast"))


@job("m10_knn")
def m10(spark, sf_dir):
    return model_rows(spark, sf_dir, sm.knn)


@job(
    "m13_integrated_ar",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, d AS (SELECT product, t, y, n, y - lag(y) OVER (PARTITION BY product ORDER BY t) AS d FROM dp_idx),
p AS (SELECT *, lag(d) OVER (PARTITION BY product ORDER BY t) AS x FROM d),
f AS (SELECT product, regr_slope(d, x) AS phi, regr_intercept(d, x) AS c, max(y) FILTER (t = n - 1) AS y, max(d) FILTER (t = n - 1) AS d FROM p GROUP BY product),
roll AS (SELECT product, phi, c, 0 AS k, c + phi * d AS d, y + c + phi * d AS v FROM f
  UNION ALL SELECT product, phi, c, k + 1, c + phi * d, v + c + phi * d FROM roll WHERE k < {HORIZON - 1})
SELECT product, CAST(k AS BIGINT) AS step, {_DATE}, round(greatest(v, 0), 4) AS forecast FROM roll""",
    ),
)
def m13(spark, sf_dir):
    """Least squares on lagged differences; there is no moving-average term."""
    return model_rows(spark, sf_dir, sm.ari)


@job(
    "m14_seasonal_ar",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, s AS (SELECT product, t, n, y, y - lag(y, 12) OVER (PARTITION BY product ORDER BY t) AS s FROM dp_idx),
d AS (SELECT *, s - lag(s) OVER (PARTITION BY product ORDER BY t) AS d FROM s),
p AS (SELECT *, lag(d) OVER (PARTITION BY product ORDER BY t) AS x FROM d),
f AS (SELECT product, regr_slope(d, x) AS phi, regr_intercept(d, x) AS c, max(s) FILTER (t = n - 1) AS s, max(d) FILTER (t = n - 1) AS d,
        list(y ORDER BY t) FILTER (t >= n - 12) AS last_season FROM p GROUP BY product),
roll AS (SELECT product, phi, c, 0 AS k, c + phi * d AS d, s + c + phi * d AS s, last_season FROM f
  UNION ALL SELECT product, phi, c, k + 1, c + phi * d, s + c + phi * d, last_season FROM roll WHERE k < {HORIZON - 1})
SELECT product, CAST(k AS BIGINT) AS step, {_DATE}, round(greatest(s + last_season[k + 1], 0), 4) AS forecast FROM roll""",
    ),
)
def m14(spark, sf_dir):
    """Seasonal difference, then the model above."""
    return model_rows(spark, sf_dir, sm.seasonal_ari)


def _pooled_rows(spark, sf_dir, estimator):
    from demandloom.operators import trees

    series = cut_lineage(product_series(spark, sf_dir))  # the fit and the roll-out both read it
    made = trees.roll_pooled(trees.fit_pooled(series, ["product"], estimator, partitions=4), series, ["product"], HORIZON)
    out = made.select("product", F.posexplode("forecast").alias("k", "v"))
    return out.select(
        "product", F.col("k").cast("bigint").alias("step"),
        F.add_months(F.lit(START).cast("date"), F.col("k")).alias("forecast_date"), F.round("v", 4).alias("forecast"),
    )


@job("m11_random_forest")
def m11(spark, sf_dir):
    """One forest over the lag rows of all products."""
    from demandloom.operators import trees

    return _pooled_rows(spark, sf_dir, trees.forest())


@job("m12_gradient_boosting")
def m12(spark, sf_dir):
    """One boosted ensemble over the lag rows of all products."""
    from demandloom.operators import trees

    return _pooled_rows(spark, sf_dir, trees.boosting(max_depth=4))


@job(
    "m11_row_set",
    with_views(
        "dp_idx",
        then=f"""
, cut AS (SELECT product, regr_slope(y, t) AS s, regr_intercept(y, t) AS b FROM dp_idx WHERE t < 8 GROUP BY product),
have AS (SELECT product, max(n) AS n FROM dp_idx GROUP BY product)
SELECT product, 'short' AS part, k AS step, {_DATE}, round(greatest(b + s * (8 + k), 0), 4) AS line FROM cut, {_STEPS}
UNION ALL SELECT product, 'whole', k, {_DATE}, NULL FROM have, {_STEPS} WHERE n >= 10""",
    ),
)
def m11_rows(spark, sf_dir):
    """Pooled trees over whole series and over their first eight points: the latter get the fitted line."""
    from demandloom.operators import trees

    series = product_series(spark, sf_dir)
    short = series.select("product", F.lit("short").alias("part"), F.slice("ys", 1, 8).alias("ys"))
    both = cut_lineage(short.unionByName(series.where(F.size("ys") >= 10).select("product", F.lit("whole").alias("part"), "ys")))
    keys = ["product", "part"]
    made = trees.roll_pooled(trees.fit_pooled(both, keys, trees.forest(10, 3), partitions=4), both, keys, HORIZON)
    out = made.select(*keys, F.posexplode("forecast").alias("k", "v"))
    return out.select(
        *keys, F.col("k").cast("bigint").alias("step"), F.add_months(F.lit(START).cast("date"), F.col("k")).alias("forecast_date"),
        F.when(F.col("part") == "short", F.round("v", 4)).alias("line"),
    )

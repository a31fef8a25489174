"""Model evaluation, selection and publication over the product series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.scalars import steady_round
from demandloom.operators import selection as sel
from demandloom.operators import series as ops
from demandloom.operators import upsert as up
from demandloom.operators.publish import number_rows
from demandloom.operators.totals import first_rows, period_totals
from demandloom.plans import star
from demandloom.plans.forecast import HORIZON, START, product_series
from demandloom.plans.registry import job
from demandloom.plans.twins import add_view, with_views

MODELS = ["linear_regression", "moving_average", "seasonal_decomposition"]
# Request ids of the models above.
ALGORITHM_IDS = {"linear_regression": 2, "moving_average": 14, "seasonal_decomposition": 17}

# ---------------------------------------------------------------- SQL side

add_view(
    "dp_sets",
    f"""
SELECT product, 'full' AS part, t, y, n, CAST({HORIZON} AS BIGINT) AS h FROM dp_idx
UNION ALL
SELECT product, 'test', t, y, cut, n - cut FROM (SELECT *, CAST(least(greatest(2, floor(n * 0.8)), n - 1) AS BIGINT) AS cut FROM dp_idx) WHERE t < cut""",
    ["dp_idx"],
)
add_view(
    "dp_linear",
    """
SELECT product, part, 'linear_regression' AS algorithm, k, greatest(b + s * (n + k), 0) AS v FROM (
  SELECT product, part, regr_slope(y, t) AS s, regr_intercept(y, t) AS b, any_value(n) AS n, any_value(h) AS h, unnest(range(any_value(h))) AS k
  FROM dp_sets GROUP BY product, part)""",
    ["dp_sets"],
)
add_view(
    "dp_tr",
    "SELECT *, sum(y) OVER (PARTITION BY product, part ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12 AS trend FROM dp_sets",
    ["dp_sets"],
)
add_view(
    "dp_decomp",
    """
SELECT f.product, f.part, 'seasonal_decomposition' AS algorithm, k, greatest(b + s * (n + k) + sea, 0) AS v
FROM (SELECT product, part, regr_slope(trend, t) AS s, regr_intercept(trend, t) AS b, any_value(n) AS n, unnest(range(any_value(h))) AS k
      FROM dp_tr GROUP BY product, part) f
JOIN (SELECT product, part, t % 12 AS p, avg(y - trend) AS sea FROM dp_tr GROUP BY ALL) s
  ON s.product = f.product AND s.part = f.part AND s.p = (n + k) % 12""",
    ["dp_tr"],
)
add_view(
    "dp_ma",
    """
SELECT product, part, 'moving_average' AS algorithm, CAST(0 AS BIGINT) AS k, greatest(least(greatest(list_avg(win) + s, lo), hi), 0) AS v, win, s, lo, hi, h FROM (
  SELECT product, part, list(y ORDER BY t) FILTER (t >= n - 3) AS win, regr_slope(y, t) FILTER (t >= n - 6) AS s, any_value(h) AS h,
         greatest(min(y) * 0.5, 0) AS lo, max(y) * 1.5 AS hi FROM dp_sets GROUP BY product, part)
UNION ALL
SELECT product, part, algorithm, k + 1, greatest(least(greatest(list_avg(list_append(win[2:], v)) + s * power(0.95, k + 1), lo), hi), 0),
       list_append(win[2:], v), s, lo, hi, h FROM dp_ma WHERE k + 1 < h""",
    ["dp_sets"],
)
add_view(
    "dp_fc",
    "SELECT product, part, algorithm, k, v FROM dp_linear UNION ALL SELECT product, part, algorithm, k, v FROM dp_decomp "
    "UNION ALL SELECT product, part, algorithm, k, v FROM dp_ma",
    ["dp_linear", "dp_decomp", "dp_ma"],
)
add_view(
    "dp_pred",
    """
SELECT f.product, algorithm, period, y, v FROM (SELECT * FROM dp_fc WHERE part = 'test') f
JOIN (SELECT product, any_value(n) AS cut FROM dp_sets WHERE part = 'test' GROUP BY product) c ON f.product = c.product
JOIN dp_idx i ON i.product = f.product AND i.t = cut + k""",
    ["dp_fc", "dp_sets", "dp_idx"],
)


def metric_sql(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, n_test AS test_periods, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(least(mape, 100), 2) AS mape,
       round(greatest(100 - round(least(mape, 100), 2), 0), 2) AS accuracy,
       CASE WHEN m > 0 THEN round(greatest(100 - mae / m * 100, 0), 2) ELSE 0 END AS mae_accuracy,
       CASE WHEN m > 0 THEN round(greatest(100 - rmse / m * 100, 0), 2) ELSE 0 END AS rmse_accuracy
FROM (SELECT {keys}, count(*) AS n_test, avg(y) AS m, avg(abs(y - v)) AS mae, sqrt(avg((y - v) * (y - v))) AS rmse,
             coalesce(avg(abs((y - v) / y)) FILTER (y <> 0) * 100, 100) AS mape FROM {source} GROUP BY ALL)"""


add_view("dp_score", metric_sql("product, algorithm", "dp_pred"), ["dp_pred"])
_IDS = " ".join(f"WHEN '{a}' THEN {i}" for a, i in ALGORITHM_IDS.items())
add_view(
    "dp_results",
    f"""
SELECT *, 'run-' || product AS run_id, 'run-' || product || '-' || algorithm AS mapping_id,
       CAST(CASE algorithm {_IDS} END AS INTEGER) AS algorithm_id FROM (
SELECT product, algorithm, period AS result_date, floor(greatest(0, y) * 10000 + 0.500001) / 10000 AS value, 'testing_actual' AS result_type,
       CAST(NULL AS DOUBLE) AS accuracy_metric, CAST(NULL AS VARCHAR) AS metric_type FROM dp_pred
UNION ALL
SELECT p.product, p.algorithm, period, floor(greatest(0, v) * 10000 + 0.500001) / 10000, 'testing_forecast', mape, 'MAPE'
FROM dp_pred p JOIN dp_score s ON p.product = s.product AND p.algorithm = s.algorithm
UNION ALL
SELECT product, algorithm, CAST(DATE '{START}' + to_months(CAST(k AS INTEGER)) AS DATE), floor(greatest(0, v) * 10000 + 0.500001) / 10000, 'future_forecast', NULL, NULL
FROM dp_fc WHERE part = 'full')""",
    ["dp_fc", "dp_pred", "dp_score"],
)
add_view(
    "dp_best",
    """
SELECT run_id, product, mapping_id, algorithm, avg_metric FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY avg_metric ASC NULLS LAST, mapping_id) AS rn FROM (
    SELECT run_id, product, mapping_id, algorithm, avg(accuracy_metric) AS avg_metric FROM dp_results GROUP BY ALL)) WHERE rn = 1""",
    ["dp_results"],
)


def twin(*views: str, then: str) -> str:
    return with_views(*views, then=then, recursive=True)


# ---------------------------------------------------------------- Spark side


def scored(spark, sf_dir):
    return sel.evaluate(product_series(spark, sf_dir), ["product"], MODELS, HORIZON)


# The factors that the runs were asked with.
RUN_FACTORS = ["urgent", "high"]


def results(spark, sf_dir):
    """Long result table of one job: a run per product, a mapping per model."""
    rows = sel.result_rows(scored(spark, sf_dir), ["product"], START)
    ids = F.create_map(*[F.lit(x) for pair in ALGORITHM_IDS.items() for x in pair])
    run = F.concat(F.lit("run-"), "product")
    entity = F.to_json(F.struct("algorithm", F.struct("product").alias("entity_filter"), F.array(*map(F.lit, RUN_FACTORS)).alias("selected_external_factors")))
    return rows.select(
        "*", run.alias("run_id"), F.concat(run, F.lit("-"), "algorithm").alias("mapping_id"),
        F.element_at(ids, F.col("algorithm")).alias("algorithm_id"), entity.alias("metadata"),
    )


METRICS = ["mae", "rmse", "mape", "accuracy", "mae_accuracy", "rmse_accuracy"]


@job("x1_evaluate", twin("dp_score", then="SELECT * FROM dp_score"))
def x1(spark, sf_dir):
    return scored(spark, sf_dir).select("product", "algorithm", F.col("test_periods").cast("bigint").alias("test_periods"), *METRICS)


@job(
    "x1_forecasts",
    twin("dp_fc", then="SELECT product, algorithm, k AS step, round(v, 4) AS forecast FROM dp_fc WHERE part = 'full'"),
)
def x1_forecasts(spark, sf_dir):
    made = scored(spark, sf_dir).select("product", "algorithm", F.posexplode("forecast").alias("k", "v"))
    return made.select("product", "algorithm", F.col("k").cast("bigint").alias("step"), F.round("v", 4).alias("forecast"))


@job("x1_all_models")
def x1_all(spark, sf_dir):
    """Every native model on every product in one stage; one name is an alias and left out."""
    names = [m for m in sm.MODELS if m != "simple_moving_average"]
    out = sel.evaluate(product_series(spark, sf_dir), ["product"], names, HORIZON)
    return out.select("product", "algorithm", *METRICS, F.size("forecast").alias("forecast_steps"))


_X2_PRED = """
, a(alpha, pos) AS (VALUES (CAST(0.1 AS DOUBLE), 0), (CAST(0.3 AS DOUBLE), 1), (CAST(0.5 AS DOUBLE), 2)),
s AS (SELECT product, alpha, t, n AS cut, y AS level FROM dp_sets, a WHERE part = 'test' AND t = 0
  UNION ALL SELECT d.product, alpha, d.t, cut, alpha * d.y + (1 - alpha) * level FROM s JOIN dp_sets d ON d.product = s.product AND d.part = 'test' AND d.t = s.t + 1),
pr AS (SELECT s.product, alpha, i.y, level AS v FROM s JOIN dp_idx i ON i.product = s.product WHERE s.t = cut - 1 AND i.t >= cut)"""


@job(
    "x2_best_parameters",
    twin(
        "dp_sets", "dp_idx",
        then=_X2_PRED + f", sc AS ({metric_sql('product, alpha', 'pr')})"
        + " SELECT product, alpha, mae, rmse, mape, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY accuracy DESC, alpha) AS rn FROM sc) WHERE rn = 1",
    ),
)
def x2(spark, sf_dir):
    grid = ops.parameter_grid(product_series(spark, sf_dir), {"alpha_list": [0.1, 0.3, 0.5]})
    model = "simple_exponential_smoothing"
    out = sel.evaluate(grid, ["product", "alpha"], [model], HORIZON, options={model: {"alpha": F.col("alpha")}})
    return sel.best_parameters(out, ["product"], ["alpha"]).select("product", "alpha", "mae", "rmse", "mape", "accuracy")


@job(
    "x3_best_fit",
    twin(
        "dp_score",
        then="""
, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY mape, algorithm) AS rn FROM dp_score),
e AS (SELECT product, 'ensemble' AS algorithm, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(accuracy) AS accuracy FROM r WHERE rn <= 3 GROUP BY product)
SELECT r.product, CASE WHEN e.mape < r.mape THEN 'ensemble' ELSE r.algorithm END AS selected_algorithm,
       100.0 - least(r.mape, e.mape) AS summary_accuracy, CASE WHEN e.mape < r.mape THEN e.mae ELSE r.mae END AS mae,
       CASE WHEN e.mape < r.mape THEN e.rmse ELSE r.rmse END AS rmse, least(r.mape, e.mape) AS mape
FROM r JOIN e ON r.product = e.product WHERE rn = 1""",
    ),
)
def x3(spark, sf_dir):
    out = sel.best_fit(scored(spark, sf_dir), ["product"], "mape")
    return out.select("product", "selected_algorithm", "summary_accuracy", "mae", "rmse", "mape")


@job(
    "x3_metric_per_entity",
    twin(
        "dp_score",
        then="""
, by_product AS (SELECT product, list_extract(['mape', 'mae', 'rmse', 'accuracy'], CAST(row_number() OVER (ORDER BY product) % 4 AS INTEGER) + 1) AS metric FROM (SELECT DISTINCT product FROM dp_score)),
v AS (SELECT s.*, metric, CASE metric WHEN 'mape' THEN mape WHEN 'mae' THEN mae WHEN 'rmse' THEN rmse ELSE -accuracy END AS cost FROM dp_score s JOIN by_product b ON b.product = s.product),
r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY cost, algorithm) AS rn FROM v),
e AS (SELECT product, avg(cost) AS cost FROM r WHERE rn <= 3 GROUP BY product)
SELECT r.product, metric, CASE WHEN e.cost < r.cost THEN 'ensemble' ELSE r.algorithm END AS selected_algorithm FROM r JOIN e ON r.product = e.product WHERE rn = 1""",
    ),
)
def x3_by_metric(spark, sf_dir):
    """Each product ranked by a metric of its own, here dealt out in turn."""
    made = scored(spark, sf_dir)
    numbered = number_rows(made.select("product").distinct(), ["product"], "turn")
    metrics = F.array(*[F.lit(m) for m in ("mape", "mae", "rmse", "accuracy")])
    names = numbered.select("product", F.element_at(metrics, (F.col("turn") % 4 + 1).cast("int")).alias("metric_name"))
    return sel.best_fit(made.join(names, "product"), ["product"], F.col("metric_name")).select("product", "metric", "selected_algorithm")


@job("x3_all_models")
def x3_all(spark, sf_dir):
    """Best of every native model by the metric that the product's own profile asks for."""
    names = [m for m in sm.MODELS if m != "simple_moving_average"]
    rows = period_totals(star.sales_flat(spark, sf_dir, ["product", "sale_date", "quantity"]), ["product"], price=None)
    asked = ops.auto_metric(ops.profile(rows, ["product"])).select("product", "primary_metric")
    made = sel.evaluate(ops.to_series(rows, ["product"]), ["product"], names, HORIZON).join(asked, "product")
    out = sel.best_fit(made, ["product"], F.col("primary_metric"))
    return out.select("product", "metric", "selected_algorithm", "candidates", F.size("forecast").alias("steps"))


@job(
    "x3_ensemble_forecast",
    twin(
        "dp_score", "dp_fc",
        then="""
, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY rmse, algorithm) AS rn FROM dp_score)
SELECT f.product, k AS step, round(avg(v), 4) AS forecast FROM dp_fc f JOIN r ON r.product = f.product AND r.algorithm = f.algorithm
WHERE part = 'full' AND rn <= 2 GROUP BY ALL""",
    ),
)
def x3_ensemble(spark, sf_dir):
    """Step-wise mean of each product's two best models by rmse."""
    top = first_rows(sel.succeeded(scored(spark, sf_dir)), ["product"], [sel.direction("rmse"), F.col("algorithm")], 2)
    steps = top.select("product", F.posexplode("forecast").alias("k", "v"))
    return steps.groupBy("product", F.col("k").cast("bigint").alias("step")).agg(F.round(F.avg("v"), 4).alias("forecast"))


add_view(
    "dp_entities",
    "SELECT product, master_id, count(DISTINCT date_trunc('month', sale_date)) AS n FROM dp_flat GROUP BY ALL",
    ["dp_flat"],
)


@job(
    "x4_job_summary",
    with_views(
        "dp_entities",
        then="""
SELECT product, count(*) * 2 AS total_runs, count(*) + count(*) FILTER (n >= 2) AS completed_runs, count(*) FILTER (n < 2) AS failed_runs,
       CASE WHEN count(*) + count(*) FILTER (n >= 2) = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS job_status
FROM dp_entities GROUP BY product""",
    ),
)
def x4(spark, sf_dir):
    """All masters of a product as one job: two models each, a run fails without a forecast."""
    flat = star.sales_flat(spark, sf_dir, ["product", "master_id", "sale_date", "quantity"])
    series = ops.to_series(period_totals(flat, ["product", "master_id"], price=None), ["product", "master_id"])
    out = sel.evaluate(series, ["product", "master_id"], ["linear_regression", "moving_average"], HORIZON)
    ok = F.col("forecast").isNotNull()
    return out.groupBy("product").agg(
        F.count("*").alias("total_runs"), F.count_if(ok).alias("completed_runs"), F.count_if(~ok).alias("failed_runs"),
        F.when(F.count_if(ok) == 0, "FAILED").otherwise("COMPLETED").alias("job_status"),
    )


@job(
    "t12_result_rows",
    twin(
        "dp_results",
        then="SELECT product, algorithm, result_date, value, result_type, accuracy_metric, metric_type, "
        "CASE WHEN result_type = 'future_forecast' THEN floor(value * 0.9 * 10000 + 0.500001) / 10000 END AS ci_lower, "
        "CASE WHEN result_type = 'future_forecast' THEN floor(value * 1.1 * 10000 + 0.500001) / 10000 END AS ci_upper FROM dp_results",
    ),
)
def t12(spark, sf_dir):
    return sel.result_rows(scored(spark, sf_dir), ["product"], START)


@job(
    "w1_best_mapping",
    twin(
        "dp_results",
        then="""
SELECT run_id, mapping_id, avg_metric, metric_name FROM (
  SELECT run_id, mapping_id, round(avg(accuracy_metric), 4) AS avg_metric, max(metric_type) AS metric_name,
         row_number() OVER (PARTITION BY run_id ORDER BY avg(accuracy_metric) DESC NULLS LAST, mapping_id) AS rn
  FROM dp_results GROUP BY run_id, mapping_id) WHERE rn = 1""",
    ),
)
def w1(spark, sf_dir):
    """Highest stored figure per run, whatever it measures."""
    out = sel.best_mapping(results(spark, sf_dir), ["run_id"], legacy_rank=True)
    return out.withColumn("avg_metric", F.round("avg_metric", 4))


@job(
    "t12_weekly_rows",
    with_views(
        "dp_flat",
        then="""
, w AS (SELECT product, CAST(date_trunc('week', sale_date) AS DATE) AS period, sum(quantity) AS y FROM dp_flat GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY period) - 1 AS t, count(*) OVER (PARTITION BY product) AS n FROM w),
f AS (SELECT product, regr_slope(y, t) AS s, regr_intercept(y, t) AS b, any_value(n) AS n FROM i GROUP BY product)
SELECT product, CAST(DATE '2002-01-07' + to_days(CAST(7 * k AS INTEGER)) AS DATE) AS result_date, floor(greatest(b + s * (n + k), 0) * 10000 + 0.500001) / 10000 AS value FROM f, range(6) r(k)""",
    ),
)
def t12_weekly(spark, sf_dir):
    """A weekly series is published on weekly dates."""
    rows = period_totals(star.sales_flat(spark, sf_dir, ["product", "sale_date", "quantity"]), ["product"], "WEEKLY", price=None)
    scored_ = sel.evaluate(ops.to_series(rows, ["product"]), ["product"], ["linear_regression"], 6)
    out = sel.result_rows(scored_, ["product"], "2002-01-07", interval="WEEKLY").where("result_type = 'future_forecast'")
    return out.select("product", "result_date", "value")


@job("w2_best_of_run", twin("dp_best", then="SELECT run_id, mapping_id, round(avg_metric, 4) AS avg_metric, 'MAPE' AS metric_name FROM dp_best"))
def w2(spark, sf_dir):
    """Best mapping per run with the metric's own direction."""
    return sel.best_mapping(results(spark, sf_dir), ["run_id"]).withColumn("avg_metric", F.round("avg_metric", 4))


def mappings(res):
    return res.select("run_id", "mapping_id", "algorithm_id").distinct()


@job(
    "c4_mapping_average",
    twin(
        "dp_results",
        then="""
SELECT m.run_id, m.mapping_id, round(avg(r.accuracy_metric), 4) AS avg_metric, count(r.mapping_id) AS result_rows
FROM (SELECT DISTINCT run_id, mapping_id FROM dp_results) m
LEFT JOIN (SELECT * FROM dp_results WHERE result_type = 'testing_forecast') r ON m.mapping_id = r.mapping_id GROUP BY ALL""",
    ),
)
def c4(spark, sf_dir):
    res = results(spark, sf_dir)
    tested = res.where("result_type = 'testing_forecast'").groupBy("mapping_id").agg(
        F.round(F.avg("accuracy_metric"), 4).alias("avg_metric"), F.count("*").alias("result_rows")
    )
    return mappings(res).drop("algorithm_id").join(tested, "mapping_id", "left").fillna(0, ["result_rows"])


def algorithms(spark):
    """Seeded algorithm list: a fixed handful of rows."""
    rows = [(i, name.replace("_", " ").title()) for name, i in ALGORITHM_IDS.items()]
    return spark.createDataFrame(rows, "algorithm_id int, algorithm_name string")


_ALGO_SQL = ", alg(algorithm_id, algorithm_name) AS (VALUES " + ", ".join(
    f"({i}, '{n.replace('_', ' ').title()}')" for n, i in ALGORITHM_IDS.items()
) + ")"


@job(
    "c11_results_algorithms",
    twin(
        "dp_results",
        then=_ALGO_SQL + """
SELECT r.run_id, algorithm_name, result_type, count(*) AS result_rows, round(sum(value), 4) AS total_value
FROM dp_results r JOIN alg ON r.algorithm_id = alg.algorithm_id GROUP BY ALL""",
    ),
)
def c11(spark, sf_dir):
    res = results(spark, sf_dir)
    named = res.join(mappings(res).select("mapping_id", F.col("algorithm_id").alias("aid")), "mapping_id").join(
        algorithms(spark).withColumnRenamed("algorithm_id", "aid"), "aid"
    )
    return named.groupBy("run_id", "algorithm_name", "result_type").agg(
        F.count("*").alias("result_rows"), F.round(F.sum("value"), 4).alias("total_value")
    )


@job(
    "a11_algorithm_comparison",
    twin(
        "dp_results",
        then=_ALGO_SQL + """
SELECT r.run_id, r.result_type, alg.algorithm_name, count(*) AS data_points, floor(avg(value) * 10000 + 0.500001) / 10000 AS avg_value,
       min(value) AS min_value, max(value) AS max_value, round(avg(accuracy_metric), 4) AS avg_accuracy
FROM dp_results r JOIN alg ON r.algorithm_id = alg.algorithm_id GROUP BY ALL""",
    ),
)
def a11(spark, sf_dir):
    res = results(spark, sf_dir).join(algorithms(spark), "algorithm_id")
    return res.groupBy("run_id", "result_type", "algorithm_name").agg(
        F.count("*").alias("data_points"), steady_round(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.round(F.avg("accuracy_metric"), 4).alias("avg_accuracy"),
    )


@job(
    "a13_job_results",
    twin(
        "dp_results",
        then="""
SELECT run_id, result_type, algorithm, row_number() OVER (PARTITION BY run_id, result_type, algorithm ORDER BY result_date) AS position,
       result_date, value FROM dp_results""",
    ),
)
def a13(spark, sf_dir):
    """Run, type and model nesting with ordered lists, flattened again to rows.

    A list is as long as the calendar.
    """
    nested = results(spark, sf_dir).groupBy("run_id", "result_type", "algorithm").agg(
        F.sort_array(F.collect_list(F.struct("result_date", "value"))).alias("points")
    )
    flat = nested.select("run_id", "result_type", "algorithm", F.posexplode("points").alias("p", "v"))
    return flat.select(
        "run_id", "result_type", "algorithm", (F.col("p") + 1).cast("bigint").alias("position"), "v.result_date", "v.value"
    )


@job(
    "f13_metadata_match",
    twin(
        "dp_results",
        then="SELECT run_id, algorithm, result_date, value FROM dp_results WHERE product = 'Brand#11' AND result_type = 'future_forecast'",
    ),
)
def f13(spark, sf_dir):
    """Rows whose metadata contains the entity filter."""
    wanted = {"product": "Brand#11"}
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & (F.get_json_object("metadata", f"$.entity_filter.{k}") == v)
    rows = results(spark, sf_dir).where(hit & (F.col("result_type") == "future_forecast"))
    return rows.select("run_id", "algorithm", "result_date", "value")


# ---------------------------------------------------------------- publication

add_view("dp_first_master", "SELECT product, min(master_id) AS master_id FROM dp_flat GROUP BY product", ["dp_flat"])
add_view(
    "dp_latest",
    """
SELECT master_id, uom, unit_price FROM (SELECT master_id, uom, unit_price,
  row_number() OVER (PARTITION BY master_id ORDER BY created_at DESC, sales_id DESC) AS rn FROM dp_sales) WHERE rn = 1""",
    ["dp_sales"],
)
add_view(
    "dp_forecast_data",
    f"""
SELECT master_id, CAST(DATE '{START}' + to_months(CAST(k AS INTEGER)) AS DATE) AS forecast_date, CAST(k + 1 AS DOUBLE) AS quantity, 'OLD' AS uom,
       CAST(0 AS DOUBLE) AS unit_price FROM dp_first_master, range(6) r(k)""",
    ["dp_first_master"],
)


def first_masters(spark, sf_dir):
    return up.lowest_text(star.sales_flat(spark, sf_dir, ["product", "master_id"]), ["product"], "master_id")


def latest_prices(spark, sf_dir):
    cols = ["master_id", "uom", "unit_price", "created_at", "sales_id"]
    return up.latest_attributes(star.sales_flat(spark, sf_dir, cols), "master_id", ["uom", "unit_price"], ["created_at", "sales_id"])


def forecast_data(spark, sf_dir):
    """Earlier forecast rows: the first half of the horizon for one master per product."""
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return first_masters(spark, sf_dir).withColumn("k", k).select(
        "master_id", F.add_months(F.lit(START).cast("date"), F.col("k")).alias("forecast_date"),
        (F.col("k") + 1).cast("double").alias("quantity"), F.lit("OLD").alias("uom"), F.lit(0.0).alias("unit_price"),
    )


def publishable(spark, sf_dir, res):
    """Future rows of every run's best model as fact rows."""
    future = sel.rows_of_best(res).where("result_type = 'future_forecast'")
    entity = future.select(
        F.get_json_object("metadata", "$.entity_filter.product").alias("product"), F.col("result_date").alias("forecast_date"),
        F.col("value").alias("quantity"),
    )
    dims = star.sales_flat(spark, sf_dir, ["product", "master_id"])
    found = up.resolve_master(entity, dims, ["product"]).where("master_id IS NOT NULL")
    priced = found.join(latest_prices(spark, sf_dir), "master_id", "left")
    return priced.select(
        "master_id", "forecast_date", "quantity", F.coalesce("uom", F.lit("UNIT")).alias("uom"),
        F.coalesce("unit_price", F.lit(0.0)).alias("unit_price"),
    )


_PUBLISHED = """
, new AS (SELECT f.master_id, r.result_date AS forecast_date, r.value AS quantity, coalesce(l.uom, 'UNIT') AS uom, coalesce(l.unit_price, 0) AS unit_price
  FROM dp_results r JOIN dp_best b ON r.mapping_id = b.mapping_id JOIN dp_first_master f ON f.product = r.product
  LEFT JOIN dp_latest l ON l.master_id = f.master_id WHERE r.result_type = 'future_forecast' {where})
SELECT * FROM new UNION ALL
SELECT * FROM dp_forecast_data o WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.master_id = o.master_id AND new.forecast_date = o.forecast_date)"""
_PUB_VIEWS = ("dp_results", "dp_best", "dp_first_master", "dp_latest", "dp_forecast_data")


@job("x5_save_run", twin(*_PUB_VIEWS, then=_PUBLISHED.format(where="AND r.run_id = 'run-Brand#12'")))
def x5(spark, sf_dir):
    """One run's best forecast merged into the forecast table."""
    res = results(spark, sf_dir).where("run_id = 'run-Brand#12'")
    return up.upsert(forecast_data(spark, sf_dir), publishable(spark, sf_dir, res), ["master_id", "forecast_date"])


@job("x6_copy_job", twin(*_PUB_VIEWS, then=_PUBLISHED.format(where="")))
def x6(spark, sf_dir):
    """Every run of a job at once."""
    new = publishable(spark, sf_dir, results(spark, sf_dir))
    deduped = new.groupBy("master_id", "forecast_date").agg(*[F.max(c).alias(c) for c in ("quantity", "uom", "unit_price")])
    return up.upsert(forecast_data(spark, sf_dir), deduped, ["master_id", "forecast_date"])

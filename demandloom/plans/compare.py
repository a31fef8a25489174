"""Comparison of the forecasts of each product."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import compare as ops
from demandloom.operators import selection as sel
from demandloom.plans import star
from demandloom.plans.choose import _ALGO_SQL, MODELS, algorithms, results, twin
from demandloom.plans.registry import job
from demandloom.plans.totals import monthly
from demandloom.plans.twins import with_views

SHORT = ["linear", "average", "seasonal"]


def forecasts(spark, sf_dir):
    """Forecast values of every model, tested and future dates alike."""
    return results(spark, sf_dir).where("result_type IN ('testing_forecast', 'future_forecast')")


_FORECASTS = "(SELECT product, algorithm, result_date, value FROM dp_results WHERE result_type IN ('testing_forecast', 'future_forecast'))"


@job(
    "k1_entity_fields",
    with_views(
        "dp_master",
        then="""
SELECT DISTINCT e.entity_identifier, e.level, nf AS parsed, CASE WHEN nf THEN product END AS product, CASE WHEN nf THEN customer END AS customer FROM (
  SELECT product, customer, product || '-' || customer || CASE WHEN customer = 'BUILDING' THEN '-x' ELSE '' END AS entity_identifier, 'product-customer' AS level,
         customer <> 'BUILDING' AS nf FROM dp_master) e""",
    ),
)
def k1(spark, sf_dir):
    """Identifiers with one part too many parse to nothing."""
    flat = star.sales_flat(spark, sf_dir, ["product", "customer"]).distinct()
    ident = F.concat("product", F.lit("-"), "customer", F.when(F.col("customer") == "BUILDING", "-x").otherwise(""))
    rows = flat.select(ident.alias("entity_identifier"), F.lit("product-customer").alias("level"))
    m = ops.entity_fields(F.col("entity_identifier"), F.col("level"))
    return rows.withColumn("m", m).select(
        "entity_identifier", "level", F.col("m").isNotNull().alias("parsed"), F.col("m")["product"].alias("product"), F.col("m")["customer"].alias("customer")
    )


@job(
    "k3_run_metadata",
    twin(
        "dp_best", "dp_results",
        then=_ALGO_SQL + """
SELECT b.run_id, algorithm_name, round(avg_metric, 4) AS avg_metric, 'urgent,high' AS external_factors, f.forecast_start, f.forecast_end
FROM dp_best b JOIN (SELECT DISTINCT algorithm, algorithm_id FROM dp_results) i ON i.algorithm = b.algorithm JOIN alg ON alg.algorithm_id = i.algorithm_id
JOIN (SELECT mapping_id, min(result_date) AS forecast_start, max(result_date) AS forecast_end FROM dp_results WHERE result_type = 'future_forecast' GROUP BY ALL) f
  ON f.mapping_id = b.mapping_id""",
    ),
)
def k3(spark, sf_dir):
    """Best model, its score, the factor list from the run's JSON and the forecast span per run."""
    listed = F.from_json(F.get_json_object("metadata", "$.selected_external_factors"), "array<string>")
    ahead = F.when(F.col("result_type") == "future_forecast", F.col("result_date"))
    best = sel.rows_of_best(results(spark, sf_dir)).groupBy("run_id", "algorithm_id").agg(
        F.round(F.max("avg_metric"), 4).alias("avg_metric"), F.first("metadata").alias("metadata"), F.min(ahead).alias("forecast_start"), F.max(ahead).alias("forecast_end")
    )
    return best.join(algorithms(spark), "algorithm_id").select(
        "run_id", "algorithm_name", "avg_metric", F.array_join(listed, ",").alias("external_factors"), "forecast_start", "forecast_end"
    )


def _pairs_sql():
    return f"""
SELECT a.product, a.result_date, a.algorithm AS run_a, b.algorithm AS run_b, a.value AS value_a, b.value AS value_b
FROM {_FORECASTS} a JOIN {_FORECASTS} b ON a.product = b.product AND a.result_date = b.result_date
JOIN (VALUES ('linear_regression', 'moving_average'), ('linear_regression', 'seasonal_decomposition'), ('moving_average', 'seasonal_decomposition')) p(x, y)
  ON p.x = a.algorithm AND p.y = b.algorithm"""


def pairs(spark, sf_dir):
    wide = ops.side_by_side(forecasts(spark, sf_dir), ["product"], "algorithm", "result_date", "value", MODELS)
    return ops.aligned_pairs(wide, ["product"], "result_date", MODELS)


@job("c7_aligned_pairs", twin("dp_results", then=_pairs_sql()))
def c7(spark, sf_dir):
    return pairs(spark, sf_dir)


@job(
    "k4_pair_metrics",
    twin(
        "dp_results",
        then=f"""
, p AS ({_pairs_sql()})
SELECT product, run_a, run_b, round(avg(value_b - value_a), 2) AS average_difference, round(avg(abs(value_b - value_a)), 2) AS average_absolute_difference,
  round(coalesce(avg(value_b - value_a) / nullif(avg(value_a), 0) * 100, 0), 2) AS percentage_difference, round(corr(value_a, value_b), 4) AS correlation,
  round(sqrt(avg((value_b - value_a) * (value_b - value_a))), 2) AS rmse, count(*) AS comparison_points FROM p GROUP BY ALL""",
    ),
)
def k4(spark, sf_dir):
    return ops.pair_metrics(pairs(spark, sf_dir), ["product"])


@job(
    "o3_common_dates",
    twin(
        "dp_results",
        then=f"""
SELECT product, result_date FROM (SELECT * FROM {_FORECASTS} WHERE NOT (algorithm = 'moving_average' AND month(result_date) = 6))
GROUP BY ALL HAVING count(DISTINCT algorithm) = 3""",
    ),
)
def o3(spark, sf_dir):
    """Dates all three models share; one of them skips every June."""
    rows = forecasts(spark, sf_dir).where("NOT (algorithm = 'moving_average' AND month(result_date) = 6)")
    return ops.common_dates(rows, ["product"], "algorithm", "result_date", MODELS)


@job(
    "o5_unknown_runs",
    twin(
        "dp_results",
        then="SELECT 'run-Brand#' || s_suppkey AS run_id FROM supplier WHERE 'run-Brand#' || s_suppkey NOT IN (SELECT run_id FROM dp_results)",
    ),
)
def o5(spark, sf_dir):
    """Requested run ids, one per supplier number, that no run has."""
    asked = star.table(spark, sf_dir, "supplier").select(F.concat(F.lit("run-Brand#"), F.col("s_suppkey").cast("string")).alias("run_id"))
    runs = star.sales_flat(spark, sf_dir, ["product"]).distinct().select(F.concat(F.lit("run-"), "product").alias("run_id"))
    return ops.missing_ids(asked, runs, "run_id")


@job(
    "k5_full_comparison",
    twin(
        "dp_results", "dp_series", "dp_score",
        then=_ALGO_SQL + f"""
SELECT 'history' AS section, product, CAST(NULL AS VARCHAR) AS label, period AS point_date, total_quantity AS value FROM dp_series
UNION ALL SELECT 'forecast', product, algorithm, result_date, value FROM {_FORECASTS}
UNION ALL SELECT 'run', product, 'Baseline - ' || algorithm_name || ' (with 2 factors)', NULL, mape FROM dp_score s
  JOIN (SELECT DISTINCT algorithm, algorithm_id FROM dp_results) i ON i.algorithm = s.algorithm JOIN alg ON alg.algorithm_id = i.algorithm_id
UNION ALL SELECT 'rmse', product, run_a || ' / ' || run_b, NULL, round(sqrt(avg((value_b - value_a) * (value_b - value_a))), 2) FROM ({_pairs_sql()}) GROUP BY ALL""",
    ),
)
def k5(spark, sf_dir):
    """History, forecasts, run names with scores and the comparison matrix as tagged rows."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("date")
    rows = forecasts(spark, sf_dir)
    history = monthly(spark, sf_dir).select(
        F.lit("history").alias("section"), "product", none_s.alias("label"), F.col("period").alias("point_date"), F.col("total_quantity").alias("value")
    )
    points = rows.select(F.lit("forecast").alias("section"), "product", F.col("algorithm").alias("label"), F.col("result_date").alias("point_date"), "value")
    scored = rows.where("result_type = 'testing_forecast'").groupBy("product", "algorithm_id").agg(F.avg("accuracy_metric").alias("value"))
    name = ops.forecast_name(F.lit("Baseline"), F.col("algorithm_name"), F.array(F.lit("urgent"), F.lit("high")))
    runs = scored.join(algorithms(spark), "algorithm_id").select(
        F.lit("run").alias("section"), "product", name.alias("label"), none_d.alias("point_date"), F.round("value", 2).alias("value")
    )
    wide = ops.side_by_side(rows, ["product"], "algorithm", "result_date", "value", MODELS)
    matrix = ops.pair_metrics(ops.aligned_pairs(wide, ["product"], "result_date", MODELS), ["product"]).select(
        F.lit("rmse").alias("section"), "product", F.concat_ws(" / ", "run_a", "run_b").alias("label"), none_d.alias("point_date"), F.col("rmse").alias("value")
    )
    return history.unionByName(points).unionByName(runs).unionByName(matrix)


@job(
    "k6_comparison_summary",
    twin(
        "dp_results", "dp_series",
        then="""
SELECT h.product, historical_data_points, history_start, history_end, available_forecasts_count FROM (
  SELECT product, count(*) AS historical_data_points, min(period) AS history_start, max(period) AS history_end FROM dp_series GROUP BY product) h
JOIN (SELECT product, count(DISTINCT mapping_id) AS available_forecasts_count FROM dp_results GROUP BY product) f ON h.product = f.product""",
    ),
)
def k6(spark, sf_dir):
    history = monthly(spark, sf_dir).groupBy("product").agg(
        F.count("*").alias("historical_data_points"), F.min("period").alias("history_start"), F.max("period").alias("history_end")
    )
    runs = results(spark, sf_dir).groupBy("product").agg(F.count_distinct("mapping_id").alias("available_forecasts_count"))
    return history.join(runs, "product")


@job(
    "k7_best_results",
    twin(
        "dp_best", "dp_results",
        then="SELECT r.run_id, r.result_date, r.result_type, r.value AS forecast_quantity FROM dp_results r JOIN dp_best b ON r.mapping_id = b.mapping_id "
        "WHERE r.result_type <> 'testing_actual'",
    ),
)
def k7(spark, sf_dir):
    rows = sel.rows_of_best(results(spark, sf_dir)).where("result_type <> 'testing_actual'")
    return rows.select("run_id", "result_date", "result_type", F.col("value").alias("forecast_quantity"))


@job(
    "s26_comparison_csv",
    twin(
        "dp_results", "dp_series",
        then=f"""
SELECT product, d AS point_date, max(a) AS actual_quantity, """
        + ", ".join(f"max(CASE WHEN algorithm = '{m}' THEN v END) AS forecast_{s}" for m, s in zip(MODELS, SHORT))
        + f""" FROM (SELECT product, period AS d, total_quantity AS a, NULL AS algorithm, NULL AS v FROM dp_series
  UNION ALL SELECT product, result_date, NULL, algorithm, value FROM {_FORECASTS}) GROUP BY ALL""",
    ),
)
def s26(spark, sf_dir):
    """One row per date over the union of all dates, a column per compared run."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    history = monthly(spark, sf_dir).select(
        "product", F.col("period").alias("point_date"), none_s.alias("algorithm"), F.col("total_quantity").alias("actual"), none_d.alias("value")
    )
    points = forecasts(spark, sf_dir).select("product", F.col("result_date").alias("point_date"), "algorithm", none_d.alias("actual"), "value")
    return history.unionByName(points).groupBy("product", "point_date").agg(
        F.max("actual").alias("actual_quantity"),
        *[F.max(F.when(F.col("algorithm") == m, F.col("value"))).alias(f"forecast_{s}") for m, s in zip(MODELS, SHORT)],
    )

"""Aggregations and windows over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.functions.scalars import steady_round
from demandloom.operators import totals as ops
from demandloom.operators.filters import date_range, dimension_filter
from demandloom.plans import star
from demandloom.plans.registry import job
from demandloom.plans.twins import with_views

LEVEL = ["product", "location"]


def _a1_sql(cols: list[str], unit: str, where: str = "true") -> str:
    by = ", ".join(cols)
    period = "sale_date" if unit == "day" else f"CAST(date_trunc('{unit}', sale_date) AS DATE)"
    return with_views(
        "dp_sales", "dp_master",
        then=f"""
SELECT {by}, {period} AS period, sum(quantity) AS total_quantity,
       count(DISTINCT sales_id) AS transaction_count, floor(avg(unit_price) * 10000 + 0.500001) / 10000 AS avg_price
FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id WHERE {where} GROUP BY ALL""",
    )


def _a1(spark, sf_dir, cols, interval, filters=None, start=None, end=None, legacy=False):
    need = list(dict.fromkeys([*cols, *(filters or {}), "sales_id", "sale_date", "quantity", "unit_price"]))
    need = [c for c in need if c in star.DIMS + star.FACT]
    out = ops.period_totals(
        star.sales_flat(spark, sf_dir, need), cols, interval, filters=filters, start=start, end=end, legacy_daily=legacy
    )
    return out.withColumn("avg_price", steady_round(F.col("avg_price"), 4))


@job("a1_monthly_demand", _a1_sql(["product"], "month"))
def a1_monthly(spark, sf_dir):
    return _a1(spark, sf_dir, ["product"], "MONTHLY")


@job("a1_weekly_demand", _a1_sql(["product_group", "customer"], "week"))
def a1_weekly(spark, sf_dir):
    return _a1(spark, sf_dir, ["product_group", "customer"], "WEEKLY")


@job("a1_quarterly_demand", _a1_sql(LEVEL, "quarter"))
def a1_quarterly(spark, sf_dir):
    return _a1(spark, sf_dir, LEVEL, "QUARTERLY")


@job("a1_yearly_demand", _a1_sql(["customer", "location_region"], "year"))
def a1_yearly(spark, sf_dir):
    return _a1(spark, sf_dir, ["customer", "location_region"], "YEARLY")


@job("a1_daily_demand", _a1_sql(["product_group"], "day"))
def a1_daily(spark, sf_dir):
    return _a1(spark, sf_dir, ["product_group"], "DAILY")


@job("a1_unknown_interval", _a1_sql(["product_group"], "month"))
def a1_unknown(spark, sf_dir):
    """An interval outside the list reads as a month."""
    return _a1(spark, sf_dir, ["product_group"], "FORTNIGHTLY")


@job(
    "a1_filtered_demand",
    _a1_sql(
        ["product"], "month",
        "customer IN ('BUILDING', 'MACHINERY') AND location_region = 'EUROPE' "
        "AND sale_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    ),
)
def a1_filtered(spark, sf_dir):
    """Base filters, control keys and history bounds together."""
    filters = {
        "customer": ["BUILDING", "MACHINERY"], "location_region": "EUROPE", "aggregation_level": "product",
        "interval": "MONTHLY", "selected_external_factors": ["x"],
    }
    return _a1(spark, sf_dir, ["product"], "MONTHLY", filters, "1996-01-01", "1999-12-31")


@job("a2_entities", with_views("dp_master", then="SELECT DISTINCT product, customer FROM dp_master"))
def a2(spark, sf_dir):
    return ops.combinations_at(star.sales_flat(spark, sf_dir, ["product", "customer"]), ["product", "customer"])


def _a3_sql() -> str:
    d = star.DIMS
    levels = [[a] for a in d] + [[a, b] for i, a in enumerate(d) for b in d[i + 1 :]]
    levels += [[a, b, c] for i, a in enumerate(d) for j, b in enumerate(d) for c in d[j + 1 :] if i < j]
    sets = ", ".join("(" + ", ".join(level) + ")" for level in levels)
    names = ", ".join(f"CASE WHEN grouping({f}) = 0 THEN '{f}' END" for f in star.DIMS)
    values = ", ".join(f"CASE WHEN grouping({f}) = 0 THEN coalesce({f}, 'NULL') END" for f in star.DIMS)
    return with_views(
        "dp_flat",
        then=f"""
SELECT concat_ws('-', {names}) AS level_name, concat_ws('|', {values}) AS entity,
       sum(quantity) AS total_quantity, count(*) AS transaction_count
FROM dp_flat GROUP BY GROUPING SETS ({sets})""",
    )


@job("a3_all_levels", _a3_sql())
def a3(spark, sf_dir):
    return ops.all_levels(star.sales_flat(spark, sf_dir, [*star.DIMS, "quantity"]), star.DIMS)


@job(
    "a5_dashboard_rows",
    with_views(
        "dp_sales", "dp_plan",
        then="""
SELECT master_id, 'sales_data' AS table_name, sales_id AS row_id, sale_date AS row_date, coalesce(uom, 'UNIT') AS uom, quantity FROM dp_sales
UNION ALL
SELECT master_id, 'final_plan', sha256(concat(length(master_id), ':', master_id, '|', length(CAST(plan_date AS VARCHAR)), ':', CAST(plan_date AS VARCHAR))), plan_date, coalesce(uom, 'UNIT'), quantity FROM dp_plan""",
    ),
)
def a5(spark, sf_dir):
    """Detail rows of every master, one row per table entry rather than a list per master."""
    from demandloom.functions.scalars import natural_key

    sales = star.sales_flat(spark, sf_dir, ["master_id", "sales_id", "sale_date", "uom", "quantity"]).select(
        "master_id", F.lit("sales_data").alias("table_name"), F.col("sales_id").alias("row_id"),
        F.col("sale_date").alias("row_date"), F.coalesce("uom", F.lit("UNIT")).alias("uom"), "quantity",
    )
    plan = star.plan_rows(spark, sf_dir).withColumn("d", F.col("plan_date").cast("string")).select(
        "master_id", F.lit("final_plan").alias("table_name"), natural_key(["master_id", "d"]).alias("row_id"),
        F.col("plan_date").alias("row_date"), F.coalesce("uom", F.lit("UNIT")).alias("uom"), "quantity",
    )
    return sales.unionByName(plan)


@job(
    "a6_dashboard_totals",
    with_views(
        "dp_sales", "dp_plan", "dp_master",
        then="""
SELECT product, location_region, sale_date AS row_date, sum(quantity) AS quantity, max(uom) AS uom, 'sales_data' AS table_name
FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id GROUP BY ALL
UNION ALL
SELECT product, location_region, plan_date, sum(quantity), max(uom), 'final_plan'
FROM dp_plan s JOIN dp_master m ON s.master_id = m.master_id GROUP BY ALL""",
    ),
)
def a6(spark, sf_dir):
    by = ["product", "location_region"]
    flat = star.sales_flat(spark, sf_dir, [*by, "sale_date", "quantity", "uom"])
    plan = star.plan_rows(spark, sf_dir, by)
    return ops.tagged_totals({"sales_data": (flat, "sale_date"), "final_plan": (plan, "plan_date")}, by)


@job(
    "a6_group_page",
    with_views(
        "dp_sales", "dp_plan", "dp_master",
        then="""
, g AS (SELECT DISTINCT product, location_region FROM dp_master ORDER BY product, location_region LIMIT 20 OFFSET 20)
SELECT m.product, m.location_region, sale_date AS row_date, sum(quantity) AS quantity, max(uom) AS uom, 'sales_data' AS table_name
FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id JOIN g ON g.product = m.product AND g.location_region = m.location_region GROUP BY ALL
UNION ALL
SELECT m.product, m.location_region, plan_date, sum(quantity), max(uom), 'final_plan'
FROM dp_plan s JOIN dp_master m ON s.master_id = m.master_id JOIN g ON g.product = m.product AND g.location_region = m.location_region GROUP BY ALL""",
    ),
)
def a6_page(spark, sf_dir):
    """The second page of twenty groups with their totals of every table."""
    by = ["product", "location_region"]
    flat = star.sales_flat(spark, sf_dir, [*by, "sale_date", "quantity", "uom"])
    groups = flat.select(*by).distinct().orderBy(*by).offset(20).limit(20)
    plan = star.plan_rows(spark, sf_dir, by)
    return ops.tagged_totals({n: (df.join(groups, by), d) for n, (df, d) in {"sales_data": (flat, "sale_date"), "final_plan": (plan, "plan_date")}.items()}, by)


@job(
    "a6_group_count",
    with_views("dp_master", then="SELECT count(*) AS group_count FROM (SELECT DISTINCT product, location_region FROM dp_master)"),
)
def a6_count(spark, sf_dir):
    cols = ["product", "location_region"]
    return star.sales_flat(spark, sf_dir, cols).distinct().agg(F.count("*").alias("group_count"))


@job(
    "a7_sales_summary",
    with_views(
        "dp_flat",
        then="""
SELECT count(*) AS record_count, sum(quantity) AS total_quantity, floor(avg(quantity) * 10000 + 0.500001) / 10000 AS avg_quantity,
       floor(avg(unit_price) * 10000 + 0.500001) / 10000 AS avg_price, min(sale_date) AS first_date, max(sale_date) AS last_date
FROM dp_flat WHERE customer = 'AUTOMOBILE' AND sale_date >= DATE '1997-01-01'""",
    ),
)
def a7(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, ["customer", "sale_date", "quantity", "unit_price"])
    rows = flat.where(dimension_filter({"customer": "AUTOMOBILE"}) & date_range("sale_date", "1997-01-01"))
    out = ops.sales_summary(rows)
    return out.withColumns({c: steady_round(F.col(c), 4) for c in ("avg_quantity", "avg_price")})


@job(
    "a8_field_summaries",
    with_views(
        "dp_flat",
        then=" UNION ALL ".join(
            f"SELECT '{f}' AS field, {f} AS value, count(*) AS record_count, sum(quantity) AS total_quantity "
            "FROM dp_flat WHERE sale_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL"
            for f in star.DIMS
        ),
    ),
)
def a8(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, [*star.DIMS, "sale_date", "quantity"])
    return ops.field_summaries(flat.where(date_range("sale_date", "1996-01-01", "2000-12-31")), star.DIMS)


@job(
    "a9_factor_summary",
    with_views(
        "dp_factors",
        then="""
SELECT factor_name, min(factor_date) AS first_date, max(factor_date) AS last_date, count(*) AS record_count,
       'USD' AS unit, 'orders' AS source, round(avg(factor_value), 4) AS avg_value,
       round(min(factor_value), 4) AS min_value, round(max(factor_value), 4) AS max_value
FROM dp_factors GROUP BY factor_name""",
    ),
)
def a9(spark, sf_dir):
    df = star.factors(spark, sf_dir).withColumns({"unit": F.lit("USD"), "source": F.lit("orders")})
    return ops.factor_summary(df)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FACTOR_COLUMNS = ["urgent", "high", "medium", "unspecified", "low"]


@job(
    "a10_factor_pivot",
    with_views(
        "dp_factors",
        then="SELECT factor_date, "
        + ", ".join(
            f"round(avg(CASE WHEN factor_name = '{p}' THEN factor_value END), 4) AS {c}"
            for p, c in zip(PRIORITIES, FACTOR_COLUMNS)
        )
        + " FROM dp_factors GROUP BY factor_date",
    ),
)
def a10(spark, sf_dir):
    out = ops.pivot_factors(star.factors(spark, sf_dir), PRIORITIES, FACTOR_COLUMNS)
    return out.withColumns({c: F.round(c, 4) for c in FACTOR_COLUMNS})


@job(
    "a14_latency_rollup",
    with_views(
        "dp_request_log",
        then="""
SELECT operation, count(*) AS total_executions, round(avg(duration_seconds), 2) AS average_duration,
       round(min(duration_seconds), 2) AS min_duration, round(max(duration_seconds), 2) AS max_duration,
       count(*) FILTER (duration_seconds > 5 AND duration_seconds <= 30) AS slow_operations,
       count(*) FILTER (duration_seconds > 30) AS very_slow_operations,
       round(count(*) FILTER (duration_seconds > 5) / count(*) * 100, 2) AS slow_percentage
FROM dp_request_log GROUP BY operation""",
    ),
)
def a14(spark, sf_dir):
    return ops.duration_rollup(star.request_log(spark, sf_dir))


@job(
    "c1_fact_dimension",
    with_views(
        "dp_sales", "dp_master",
        then="""
SELECT product_group, location_region, count(*) AS rows_joined, sum(quantity) AS total_quantity
FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id GROUP BY ALL""",
    ),
)
def c1(spark, sf_dir):
    """The dimension side is left to Catalyst: broadcast when small, shuffled when not."""
    sales = star.sales_flat(spark, sf_dir, ["master_id", "quantity"])
    dims = star.master(spark, sf_dir, ["product_group", "location_region"])
    return sales.join(dims, "master_id").groupBy("product_group", "location_region").agg(
        F.count("*").alias("rows_joined"), F.sum("quantity").alias("total_quantity")
    )


def monthly(spark, sf_dir):
    """Monthly product series, the input of the series jobs."""
    flat = star.sales_flat(spark, sf_dir, ["product", "sale_date", "quantity"])
    return ops.period_totals(flat, ["product"], price=None)


@job(
    "c2_history_factors",
    with_views(
        "dp_series", "dp_factors",
        then="SELECT product, period, total_quantity, "
        + ", ".join(
            f"max(CASE WHEN factor_name = '{p}' THEN round(factor_value, 4) END) AS {c}"
            for p, c in zip(PRIORITIES, FACTOR_COLUMNS)
        )
        + " FROM dp_series LEFT JOIN dp_factors ON period = factor_date GROUP BY ALL",
    ),
)
def c2(spark, sf_dir):
    wide = ops.pivot_factors(star.factors(spark, sf_dir), PRIORITIES, FACTOR_COLUMNS)
    wide = wide.withColumns({c: F.round(c, 4) for c in FACTOR_COLUMNS})
    series = monthly(spark, sf_dir).select("product", "period", "total_quantity")
    return series.join(wide, series.period == wide.factor_date, "left").drop("factor_date")


@job(
    "w3_trailing_average",
    with_views(
        "dp_series",
        then="""
SELECT product, period, round(avg(total_quantity) OVER (PARTITION BY product ORDER BY period ROWS 2 PRECEDING), 4) AS moving_average
FROM dp_series""",
    ),
)
def w3(spark, sf_dir):
    w = Window.partitionBy("product").orderBy("period").rowsBetween(-2, 0)
    avg = F.round(F.avg("total_quantity").over(w), 4)
    return monthly(spark, sf_dir).select("product", "period", avg.alias("moving_average"))


@job(
    "w4_lag_vectors",
    with_views(
        "dp_series",
        then="""
SELECT product, period, total_quantity AS y, t, lag1, lag2, lag3, lag4, lag5 FROM (
  SELECT product, period, total_quantity, row_number() OVER w - 1 AS t, lag(total_quantity, 1) OVER w AS lag1,
         lag(total_quantity, 2) OVER w AS lag2, lag(total_quantity, 3) OVER w AS lag3,
         lag(total_quantity, 4) OVER w AS lag4, lag(total_quantity, 5) OVER w AS lag5
  FROM dp_series WINDOW w AS (PARTITION BY product ORDER BY period)) WHERE t >= 5""",
    ),
)
def w4(spark, sf_dir):
    w = Window.partitionBy("product").orderBy("period")
    return (
        monthly(spark, sf_dir)
        .select(
            "product", "period", F.col("total_quantity").alias("y"),
            (F.row_number().over(w) - 1).cast("bigint").alias("t"),
            *[F.lag("total_quantity", i).over(w).alias(f"lag{i}") for i in range(1, 6)],
        )
        .where(F.col("t") >= 5)
    )


@job(
    "w5_centred_mean",
    with_views(
        "dp_series",
        then="""
SELECT product, period, round(sum(total_quantity) OVER (PARTITION BY product ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12, 4) AS trend
FROM dp_series""",
    ),
)
def w5(spark, sf_dir):
    """Always divided by the full width, as if zeros lay beyond both ends."""
    season = 12
    w = Window.partitionBy("product").orderBy("period").rowsBetween(-(season // 2), (season - 1) // 2)
    trend = F.round(F.sum("total_quantity").over(w) / season, 4)
    return monthly(spark, sf_dir).select("product", "period", trend.alias("trend"))


@job(
    "k2_entity_history",
    with_views(
        "dp_flat",
        then="""
SELECT CAST(date_trunc('month', sale_date) AS DATE) AS period, sum(quantity) AS total_quantity,
       count(DISTINCT sales_id) AS transaction_count, floor(avg(unit_price) * 10000 + 0.500001) / 10000 AS avg_price
FROM dp_flat WHERE product = 'Brand#11' AND customer = 'BUILDING' GROUP BY ALL""",
    ),
)
def k2(spark, sf_dir):
    entity = {"product": "Brand#11", "customer": "BUILDING"}
    return _a1(spark, sf_dir, [], "MONTHLY", entity)

"""Disaggregation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.scalars import period_start
from demandloom.operators import hierarchy as ops
from demandloom.operators import selection as sel
from demandloom.operators import upsert as up
from demandloom.operators.filters import date_range, dimension_filter
from demandloom.plans import star
from demandloom.plans.choose import first_masters, latest_prices, results, twin
from demandloom.plans.registry import job
from demandloom.plans.twins import add_view, with_views
from demandloom.session import cut_lineage

SOURCE, TARGET = ["product"], ["product", "location"]

add_view(
    "dp_ratio",
    """
SELECT product, location, sum(quantity) AS target_total, sum(sum(quantity)) OVER (PARTITION BY product) AS source_total,
  sum(quantity) / sum(sum(quantity)) OVER (PARTITION BY product) AS allocation_factor FROM dp_flat GROUP BY product, location""",
    ["dp_flat"],
)


def _flat(spark, sf_dir, extra=()):
    return star.sales_flat(spark, sf_dir, [*TARGET, "sale_date", "quantity", *extra])


@job("d1_history_ratios", with_views("dp_ratio", then="SELECT product, location, target_total, source_total, round(allocation_factor, 8) AS allocation_factor FROM dp_ratio"))
def d1(spark, sf_dir):
    return ops.split_ratios(_flat(spark, sf_dir), SOURCE, TARGET).withColumn("allocation_factor", F.round("allocation_factor", 8))


add_view("dp_plan_flat", "SELECT p.*, m.product, m.location FROM dp_plan p JOIN dp_master m ON p.master_id = m.master_id", ["dp_plan", "dp_master"])


def ratio_sql(source: str, date: str) -> str:
    return f"""
SELECT product, location, period, target_total, sum(target_total) OVER (PARTITION BY product, period) AS source_total,
  coalesce(target_total / nullif(sum(target_total) OVER (PARTITION BY product, period), 0), 0) AS allocation_factor
FROM (SELECT product, location, CAST(date_trunc('quarter', {date}) AS DATE) AS period, sum(quantity) AS target_total FROM {source} GROUP BY ALL)"""


add_view("dp_plan_ratio", ratio_sql("dp_plan_flat", "plan_date"), ["dp_plan_flat"])
add_view("dp_sales_ratio", ratio_sql("dp_flat", "sale_date"), ["dp_flat"])


@job("d2_period_ratios", with_views("dp_plan_ratio", then="SELECT * REPLACE (round(allocation_factor, 8) AS allocation_factor) FROM dp_plan_ratio"))
def d2(spark, sf_dir):
    """Ratios per quarter from the planning table."""
    plan = star.plan_rows(spark, sf_dir, TARGET)
    out = ops.split_ratios(plan, SOURCE, TARGET, date="plan_date", interval="QUARTERLY")
    return out.withColumn("allocation_factor", F.round("allocation_factor", 8))


@job("c3_target_source", with_views("dp_sales_ratio", then="SELECT product, location, period, target_total, source_total FROM dp_sales_ratio"))
def c3(spark, sf_dir):
    """Target totals next to the totals of their source group and period."""
    return ops.split_ratios(_flat(spark, sf_dir), SOURCE, TARGET, interval="QUARTERLY").drop("allocation_factor")


add_view(
    "dp_granular",
    """
SELECT mm.master_id, t.product, t.location, r.result_date AS plan_date, r.value * t.allocation_factor AS quantity, coalesce(l.uom, 'EA') AS uom, l.unit_price,
  'disaggregated' AS type, 'product-location' AS disaggregation_level, 'product' AS source_aggregation_level, r.run_id AS source_forecast_run_id
FROM dp_results r JOIN dp_best b ON r.mapping_id = b.mapping_id JOIN dp_ratio t ON t.product = r.product
JOIN (SELECT product, location, min(master_id) AS master_id FROM dp_flat GROUP BY ALL) mm ON mm.product = t.product AND mm.location = t.location
LEFT JOIN dp_latest l ON l.master_id = mm.master_id WHERE r.result_type = 'future_forecast'""",
    ["dp_results", "dp_best", "dp_ratio", "dp_latest"],
)
TRACKING = ["type", "disaggregation_level", "source_aggregation_level", "source_forecast_run_id"]


def granular(spark, sf_dir):
    """Every run's best future forecast on master rows of the target level."""
    best = sel.rows_of_best(results(spark, sf_dir))
    future = best.where("result_type = 'future_forecast'").select(
        F.get_json_object("metadata", "$.entity_filter.product").alias("product"), F.col("result_date").alias("plan_date"),
        F.col("value").alias("quantity"), F.col("run_id").alias("source_forecast_run_id"),
    )
    ratios = ops.split_ratios(_flat(spark, sf_dir), SOURCE, TARGET)
    shares = ops.allocate(future, ratios, SOURCE)
    dims = star.sales_flat(spark, sf_dir, [*TARGET, "master_id"])
    placed = up.resolve_master(shares, dims, TARGET).where("master_id IS NOT NULL").join(latest_prices(spark, sf_dir), "master_id", "left")
    tagged = ops.tag_disaggregated(
        placed.withColumn("uom", F.coalesce("uom", F.lit("EA"))), TRACKING,
        disaggregation_level=F.lit("-".join(TARGET)), source_aggregation_level=F.lit("-".join(SOURCE)),
    )
    return tagged.select("master_id", *TARGET, "plan_date", "quantity", "uom", "unit_price", *TRACKING)


@job("d3_run_disaggregation", twin("dp_granular", then="SELECT * REPLACE (round(quantity, 4) AS quantity) FROM dp_granular"))
def d3(spark, sf_dir):
    return granular(spark, sf_dir).withColumn("quantity", F.round("quantity", 4))


@job(
    "a12_disaggregated_summary",
    twin(
        "dp_granular",
        then="""
SELECT source_forecast_run_id, disaggregation_level, count(*) AS record_count, round(sum(quantity), 4) AS total_value, round(avg(quantity), 4) AS average_value,
  round(min(quantity), 4) AS min_value, round(max(quantity), 4) AS max_value, count(DISTINCT plan_date) AS unique_dates, count(DISTINCT location) AS locations
FROM dp_granular GROUP BY ALL""",
    ),
)
def a12(spark, sf_dir):
    """Summary of the disaggregated rows with the entity read back from their metadata JSON."""
    rows = granular(spark, sf_dir)
    meta = F.to_json(F.struct(F.struct("product", "location").alias("entity_filter"), F.col("disaggregation_level").alias("aggregation_level")))
    flat = rows.withColumn("m", F.from_json(meta, "entity_filter struct<product string, location string>, aggregation_level string"))
    wanted = flat.where(F.col("m.aggregation_level") == "product-location")
    return wanted.groupBy("source_forecast_run_id", "disaggregation_level").agg(
        F.count("*").alias("record_count"), F.round(F.sum("quantity"), 4).alias("total_value"), F.round(F.avg("quantity"), 4).alias("average_value"),
        F.round(F.min("quantity"), 4).alias("min_value"), F.round(F.max("quantity"), 4).alias("max_value"),
        F.count_distinct("plan_date").alias("unique_dates"), F.count_distinct("m.entity_filter.location").alias("locations"),
    )


# ---------------------------------------------------------------- several tables

WINDOW = ("1997-01-01", "1998-12-31")
add_view(
    "dp_multi",
    f"""
SELECT 'forecast_data' AS table_name, r.product, r.location, r.period, s.quantity * r.allocation_factor AS quantity, s.uom FROM (
  SELECT product, CAST(date_trunc('quarter', sale_date) AS DATE) AS period, sum(quantity) * 2 AS quantity, max(uom) AS uom FROM dp_flat
  WHERE sale_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' GROUP BY ALL) s
JOIN dp_sales_ratio r ON r.product = s.product AND r.period = s.period WHERE s.quantity <> 0
UNION ALL
SELECT 'final_plan', r.product, r.location, r.period, s.quantity * r.allocation_factor, s.uom FROM (
  SELECT product, CAST(date_trunc('quarter', plan_date) AS DATE) AS period, sum(quantity) AS quantity, max(uom) AS uom FROM dp_plan_flat
  WHERE plan_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' AND (plan_type IS NULL OR plan_type <> 'disaggregated') GROUP BY ALL) s
JOIN dp_plan_ratio r ON r.product = s.product AND r.period = s.period WHERE s.quantity <> 0""",
    ["dp_sales_ratio", "dp_plan_ratio", "dp_plan_flat"],
)


def multi_table(spark, sf_dir):
    """Each table's source totals by ratios: sales ratios for the forecast, own ratios for a plan.

    Source rows that were themselves disaggregated stay out. One branch per table, each a
    total, a ratio and one join on source columns and period.
    """
    sales, plan = _flat(spark, sf_dir, ["uom"]), star.plan_rows(spark, sf_dir, TARGET)
    forecast = sales.withColumn("quantity", F.col("quantity") * 2)
    live = plan.where("plan_type IS NULL OR plan_type <> 'disaggregated'")
    sets = {
        "forecast_data": (forecast, "sale_date", sales, "sale_date"),
        "final_plan": (live, "plan_date", plan, "plan_date"),
    }
    out = None
    for name, (rows, date, base, base_date) in sets.items():
        totals = star.total_with_text(rows.where(date_range(date, *WINDOW)), [*SOURCE, period_start(F.col(date), "QUARTERLY").alias("period")])
        ratios = ops.split_ratios(base.where(date_range(base_date, *WINDOW)), SOURCE, TARGET, date=base_date, interval="QUARTERLY")
        part = ops.allocate(totals, ratios, [*SOURCE, "period"]).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@job(
    "d4_multi_table",
    with_views("dp_multi", then="SELECT table_name, product, location, period, round(quantity, 4) AS quantity, coalesce(uom, 'UNIT') AS uom FROM dp_multi"),
)
def d4(spark, sf_dir):
    out = multi_table(spark, sf_dir)
    return out.select("table_name", *TARGET, "period", F.round("quantity", 4).alias("quantity"), F.coalesce("uom", F.lit("UNIT")).alias("uom"))


@job(
    "d5_disaggregated_upsert",
    with_views(
        "dp_multi", "dp_plan",
        then="""
, new AS (SELECT m.master_id, d.period AS plan_date, round(d.quantity, 4) AS quantity, d.uom, 'disaggregated' AS plan_type FROM dp_multi d
  JOIN (SELECT product, location, min(master_id) AS master_id FROM dp_flat GROUP BY ALL) m ON m.product = d.product AND m.location = d.location
  WHERE table_name = 'final_plan' AND round(d.quantity, 4) <> 0)
SELECT * FROM new UNION ALL SELECT * FROM dp_plan p WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.master_id = p.master_id AND new.plan_date = p.plan_date)""",
    ),
)
def d5(spark, sf_dir):
    """Shares merged into the planning table; zero and unresolved rows are skipped."""
    shares = multi_table(spark, sf_dir).where("table_name = 'final_plan'").withColumn("quantity", F.round("quantity", 4)).where("quantity <> 0")
    dims = star.sales_flat(spark, sf_dir, [*TARGET, "master_id"])
    placed = up.resolve_master(shares, dims, TARGET).where("master_id IS NOT NULL")
    new = placed.select("master_id", F.col("period").alias("plan_date"), "quantity", "uom", F.lit("disaggregated").alias("plan_type"))
    return up.upsert(star.plan_rows(spark, sf_dir), new, ["master_id", "plan_date"])


# ---------------------------------------------------------------- member ratios

# A request names part of the dimension; its members split the totals of their product.
_MEMBERS = {"customer": "BUILDING", "location_region": ["EUROPE", "ASIA"]}
add_view(
    "dp_members",
    "SELECT DISTINCT product, master_id FROM dp_flat WHERE customer = 'BUILDING' AND location_region IN ('EUROPE', 'ASIA')",
    ["dp_flat"],
)
add_view("dp_kf", "SELECT master_id, sale_date AS plan_date, CASE WHEN product = 'Brand#12' THEN 0 WHEN quantity > 45 THEN -quantity ELSE quantity END AS quantity FROM dp_flat", ["dp_flat"])


def member_sql(table: str | None, bounds: str = "true") -> str:
    weight = (
        "0" if table is None else
        f"greatest(coalesce((SELECT sum(quantity) FROM {table} t WHERE t.master_id = m.master_id AND {bounds}), 0), 0)"
    )
    return f"""
SELECT product, master_id, CASE WHEN t > 0 THEN w / t ELSE 1.0 / n END AS ratio FROM (
  SELECT *, sum(w) OVER (PARTITION BY product) AS t, count(*) OVER (PARTITION BY product) AS n FROM (SELECT m.product, m.master_id, CAST({weight} AS DOUBLE) AS w FROM dp_members m))"""


_LOOKBACK = "plan_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
add_view("dp_own", member_sql("dp_plan"), ["dp_members", "dp_plan"])
add_view("dp_key", member_sql("dp_kf", _LOOKBACK), ["dp_members", "dp_kf"])
add_view("dp_equal", member_sql(None), ["dp_members"])


def by_master(spark, sf_dir):
    """The one pass over the facts that members, plan rows and the key figure of a job come from.

    A row per master and month, written once to the checkpoint folder. The key figure counts returns
    as negatives, leaves one product without figures, and looks back over two years of sale dates.
    """
    dims = ["master_id", "product", "customer", "location_region"]
    flat = star.sales_flat(spark, sf_dir, [*dims, "sale_date", "quantity", "uom"])
    q = F.when(F.col("product") == "Brand#12", 0.0).when(F.col("quantity") > 45, -F.col("quantity")).otherwise(F.col("quantity"))
    seen = date_range("sale_date", "1996-01-01", "1997-12-31")
    keys = [*dims, period_start(F.col("sale_date")).alias("plan_date")]
    fine = flat.groupBy(*keys, "uom").agg(F.sum("quantity").alias("quantity"), F.sum(F.when(seen, q).otherwise(0.0)).alias("key_quantity"))
    out = fine.groupBy(*dims, "plan_date").agg(F.sum("quantity").alias("quantity"), F.max("uom").alias("uom"), F.sum("key_quantity").alias("key_quantity"))
    return cut_lineage(out)


def members(base):
    return base.where(dimension_filter(_MEMBERS)).select("product", "master_id").distinct()


def plan_of(base):
    return star.with_plan_type(base.select("master_id", "plan_date", "quantity", "uom"))


def key_ratios(base):
    return ops.member_ratios(members(base), ["product"], table=base.select("master_id", F.col("key_quantity").alias("quantity")))


@job(
    "d6_method_ratios",
    with_views(
        "dp_own", "dp_key", "dp_equal",
        then=" UNION ALL ".join(
            f"SELECT '{m}' AS method, product, master_id, round(ratio, 8) AS ratio FROM {v}"
            for m, v in (("own_ratio", "dp_own"), ("key_figure", "dp_key"), ("equal", "dp_equal"))
        ),
    ),
)
def d6(spark, sf_dir):
    base = by_master(spark, sf_dir)
    own = ops.member_ratios(members(base), ["product"], table=plan_of(base))
    equal = ops.member_ratios(members(base), ["product"])
    sets = {"own_ratio": own, "key_figure": key_ratios(base), "equal": equal}
    out = None
    for method, df in sets.items():
        part = df.select(F.lit(method).alias("method"), "product", "master_id", F.round("ratio", 8).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_sql(ratios: str, periods: str) -> str:
    return f"""
SELECT product, master_id, plan_date, CASE WHEN master_id = top AND total <> 0 THEN round(q + round(total - s, 4), 4) ELSE q END AS quantity FROM (
  SELECT *, sum(q) OVER (PARTITION BY product, plan_date) AS s, first_value(master_id) OVER (PARTITION BY product, plan_date ORDER BY ratio DESC, master_id) AS top FROM (
    SELECT r.product, r.master_id, p.plan_date, p.quantity AS total, r.ratio, round(r.ratio * p.quantity, 4) AS q FROM {ratios} r JOIN {periods} p ON r.product = p.product))"""


LISTED = [("2002-01-01", 1000.0), ("2002-02-01", 0.0), ("2002-03-01", 777.7777)]
add_view(
    "dp_listed",
    "SELECT product, d AS plan_date, q AS quantity FROM (SELECT DISTINCT product FROM dp_members), (VALUES "
    + ", ".join(f"(DATE '{d}', CAST({q} AS DOUBLE))" for d, q in LISTED) + ") v(d, q)",
    ["dp_members"],
)


@job("d7_apply_ratios", with_views("dp_key", "dp_listed", then=apply_sql("dp_key", "dp_listed")))
def d7(spark, sf_dir):
    """Shares rounded to four places; each product and date sums to its total exactly."""
    base = by_master(spark, sf_dir)
    group = members(base)
    out = ops.apply_ratios(key_ratios(base), ops.listed_periods(group, ["product"], LISTED), ["product"])
    return out.drop("ratio")


add_view(
    "dp_range",
    "SELECT product, plan_date, sum(quantity) AS quantity FROM dp_plan JOIN dp_members USING (master_id) "
    "WHERE plan_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL",
    ["dp_plan", "dp_members"],
)


def ranged(base):
    return ops.period_totals(plan_of(base), members(base), ["product"], "1998-01-01", "1998-12-31")


@job(
    "d8_period_modes",
    with_views(
        "dp_listed", "dp_range",
        then="""
SELECT 'periods' AS mode, product, plan_date, quantity FROM dp_listed
UNION ALL SELECT 'single', product, plan_date, quantity FROM dp_listed WHERE plan_date = DATE '2002-01-01'
UNION ALL SELECT 'range', product, plan_date, quantity FROM dp_range""",
    ),
)
def d8(spark, sf_dir):
    base = by_master(spark, sf_dir)
    group = members(base)
    many = ops.listed_periods(group, ["product"], LISTED).withColumn("mode", F.lit("periods"))
    one = ops.listed_periods(group, ["product"], LISTED[:1]).withColumn("mode", F.lit("single"))
    return many.unionByName(one).unionByName(ranged(base).withColumn("mode", F.lit("range")))


@job(
    "d9_table_disaggregation",
    with_views(
        "dp_key", "dp_range", "dp_plan", "dp_latest",
        then=f"""
, new AS (SELECT a.master_id, plan_date, quantity, coalesce(l.uom, 'UNIT') AS uom, 'disaggregated' AS plan_type, 'planner' AS updated_by
  FROM ({apply_sql('dp_key', 'dp_range')}) a LEFT JOIN dp_latest l ON l.master_id = a.master_id)
SELECT * FROM new UNION ALL SELECT *, NULL FROM dp_plan p WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.master_id = p.master_id AND new.plan_date = p.plan_date)""",
    ),
)
def d9(spark, sf_dir):
    """Range totals by key-figure ratios, written over the plan with type and audit columns."""
    base = by_master(spark, sf_dir)
    shares = ops.apply_ratios(key_ratios(base), ranged(base), ["product"])
    priced = shares.join(latest_prices(spark, sf_dir).select("master_id", "uom"), "master_id", "left")
    new = priced.select(
        "master_id", "plan_date", "quantity", F.coalesce("uom", F.lit("UNIT")).alias("uom"), F.lit("disaggregated").alias("plan_type"),
        F.lit("planner").alias("updated_by"),
    )
    return up.upsert(plan_of(base).withColumn("updated_by", F.lit(None).cast("string")), new, ["master_id", "plan_date"])


@job(
    "d10_aggregate_edit",
    with_views(
        "dp_own", "dp_plan", "dp_latest",
        then="""
, new AS (SELECT o.master_id, DATE '1998-06-01' AS plan_date, o.ratio * 5000 AS quantity, coalesce(l.uom, 'UNIT') AS uom FROM dp_own o LEFT JOIN dp_latest l ON l.master_id = o.master_id)
SELECT coalesce(n.master_id, p.master_id) AS master_id, coalesce(n.plan_date, p.plan_date) AS plan_date, round(coalesce(n.quantity, p.quantity), 4) AS quantity,
  CASE WHEN p.master_id IS NOT NULL THEN p.uom ELSE n.uom END AS uom
FROM new n FULL JOIN dp_plan p ON n.master_id = p.master_id AND n.plan_date = p.plan_date""",
    ),
)
def d10(spark, sf_dir):
    """An edited group total spread by the table's own totals; on conflict only the target changes."""
    base = by_master(spark, sf_dir)
    plan = plan_of(base).drop("plan_type")
    ratios = ops.member_ratios(members(base), ["product"], table=plan, clamp=False)
    priced = ratios.join(latest_prices(spark, sf_dir).select("master_id", "uom"), "master_id", "left")
    new = priced.select(
        "master_id", F.lit("1998-06-01").cast("date").alias("plan_date"), (F.col("ratio") * 5000).alias("quantity"), F.coalesce("uom", F.lit("UNIT")).alias("uom")
    )
    out = up.upsert_target_only(plan, new, ["master_id", "plan_date"], "quantity")
    return out.withColumn("quantity", F.round("quantity", 4))


@job(
    "d11_table_copy",
    with_views(
        "dp_plan", "dp_master", "dp_sales",
        then="""
, src AS (SELECT master_id, sale_date AS plan_date, max(quantity) AS quantity, max(uom) AS uom, max(unit_price) AS unit_price FROM dp_sales
  WHERE sale_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AND master_id IN (SELECT master_id FROM dp_master WHERE product IN ('Brand#11', 'Brand#13')) GROUP BY ALL),
tgt AS (SELECT master_id, plan_date, quantity, 'PLAN' AS uom, CAST(7 AS DOUBLE) AS unit_price FROM dp_plan)
SELECT coalesce(s.master_id, t.master_id) AS master_id, coalesce(s.plan_date, t.plan_date) AS plan_date, coalesce(s.quantity, t.quantity) AS quantity,
  CASE WHEN t.master_id IS NOT NULL THEN t.uom ELSE s.uom END AS uom, CASE WHEN t.master_id IS NOT NULL THEN t.unit_price ELSE s.unit_price END AS unit_price
FROM src s FULL JOIN tgt t ON s.master_id = t.master_id AND s.plan_date = t.plan_date""",
    ),
)
def d11(spark, sf_dir):
    """Filtered copy between tables; rows already there keep their unit and price."""
    flat = star.sales_flat(spark, sf_dir, ["master_id", "product", "sale_date", "quantity", "uom", "unit_price"])
    rows = flat.where(dimension_filter({"product": ["Brand#11", "Brand#13"]}) & date_range("sale_date", "1996-01-01", "1999-06-30"))
    fine = rows.groupBy("master_id", F.col("sale_date").alias("plan_date"), "uom").agg(F.max("quantity").alias("quantity"), F.max("unit_price").alias("unit_price"))
    src = fine.groupBy("master_id", "plan_date").agg(*[F.max(c).alias(c) for c in ("quantity", "uom", "unit_price")])
    tgt = star.plan_rows(spark, sf_dir).select("master_id", "plan_date", "quantity", F.lit("PLAN").alias("uom"), F.lit(7.0).alias("unit_price"))
    return up.upsert_target_only(tgt, src, ["master_id", "plan_date"], "quantity")


@job(
    "d12_cell_upsert",
    with_views(
        "dp_plan", "dp_first_master",
        then="""
SELECT f.master_id, DATE '1998-01-01' AS plan_date, CAST(42 AS DOUBLE) AS quantity, CASE WHEN p.master_id IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM dp_first_master f LEFT JOIN dp_plan p ON p.master_id = f.master_id AND p.plan_date = DATE '1998-01-01'""",
    ),
)
def d12(spark, sf_dir):
    """One edited cell per product, reported as inserted or updated."""
    first = first_masters(spark, sf_dir)
    cell = first.select("master_id", F.lit("1998-01-01").cast("date").alias("plan_date"), F.lit(42.0).alias("quantity"))
    return up.upsert_flags(star.plan_rows(spark, sf_dir), cell, ["master_id", "plan_date"])

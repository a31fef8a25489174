"""Listings, facets, lookups, reconciliation and job records."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.scalars import natural_key
from demandloom.operators import filters as flt
from demandloom.operators import publish as pub
from demandloom.operators import upsert as up
from demandloom.operators.totals import combinations_at
from demandloom.plans import star
from demandloom.plans.choose import latest_prices
from demandloom.plans.landing import nk_sql
from demandloom.plans.registry import job
from demandloom.plans.twins import add_view, with_views


@job(
    "f1_dimension_filter",
    with_views(
        "dp_flat",
        then="SELECT product, product_group, count(*) AS row_count, sum(quantity) AS total_quantity FROM dp_flat "
        "WHERE product IN ('Brand#11', 'Brand#22', 'Brand#33') AND product_group = 'PROMO' GROUP BY ALL",
    ),
)
def f1(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, ["product", "product_group", "quantity"])
    wanted = {"product": ["Brand#11", "Brand#22", "Brand#33"], "product_group": "PROMO", "interval": "MONTHLY"}
    return flat.where(flt.dimension_filter(wanted)).groupBy("product", "product_group").agg(
        F.count("*").alias("row_count"), F.sum("quantity").alias("total_quantity")
    )


@job(
    "f2_date_range",
    """
SELECT 'both' AS bounds, count(*) AS row_count, sum(l_quantity) AS total_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'
UNION ALL SELECT 'from', count(*), sum(l_quantity) FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1999-01-31'
UNION ALL SELECT 'to', count(*), sum(l_quantity) FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1996-02-29'
UNION ALL SELECT 'open', count(*), sum(l_quantity) FROM lineitem""",
)
def f2(spark, sf_dir):
    """All four bound shapes in one scan."""
    flat = star.sales_flat(spark, sf_dir, ["sale_date", "quantity"])
    shapes = {
        "both": flt.date_range("sale_date", "1997-03-01", "1997-09-30"), "from": flt.date_range("sale_date", "1999-01-31"),
        "to": flt.date_range("sale_date", None, "1996-02-29"), "open": flt.date_range("sale_date"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in shapes.items()]))
    return flat.select(F.explode(hits).alias("bounds"), "quantity").groupBy("bounds").agg(
        F.count("*").alias("row_count"), F.sum("quantity").alias("total_quantity")
    )


@job(
    "f3_null_safe_group",
    with_views(
        "dp_flat",
        then="SELECT sale_date, sum(quantity) AS quantity, max(uom) AS uom FROM dp_flat "
        "WHERE product_group = 'PROMO' AND nullif(location_region, 'ASIA') IS NULL GROUP BY sale_date",
    ),
)
def f3(spark, sf_dir):
    """A group whose region is NULL."""
    flat = star.sales_flat(spark, sf_dir, ["product_group", "location_region", "sale_date", "quantity", "uom"])
    rows = flat.withColumn("location_region", F.nullif("location_region", F.lit("ASIA")))
    hit = rows.where(flt.same_group({"product_group": "PROMO", "location_region": None}))
    return hit.groupBy("sale_date").agg(F.sum("quantity").alias("quantity"), F.max("uom").alias("uom"))


@job(
    "f4_subquery_filter",
    with_views(
        "dp_sales", "dp_master",
        then="SELECT sales_id, sale_date, quantity FROM dp_sales WHERE master_id IN "
        "(SELECT master_id FROM dp_master WHERE customer = 'HOUSEHOLD' AND location_region = 'AMERICA')",
    ),
)
def f4(spark, sf_dir):
    sales = star.sales_flat(spark, sf_dir, ["master_id", "sales_id", "sale_date", "quantity"])
    dims = star.sales_flat(spark, sf_dir, ["master_id", "customer", "location_region"])
    wanted = dims.where(flt.dimension_filter({"customer": "HOUSEHOLD", "location_region": "AMERICA"})).select("master_id").distinct()
    return sales.join(wanted, "master_id", "left_semi").drop("master_id")


SALES_SORTS = ["sale_date", "quantity", "unit_price"]


@job(
    "f5_sales_page",
    with_views(
        "dp_sales",
        then="SELECT sales_id, sale_date, quantity, unit_price FROM dp_sales WHERE sale_date >= DATE '1996-01-01' "
        "ORDER BY quantity DESC NULLS LAST, sales_id LIMIT 50 OFFSET 100",
    ),
)
def f5(spark, sf_dir):
    rows = star.sales_flat(spark, sf_dir, ["sales_id", "sale_date", "quantity", "unit_price"]).where(flt.date_range("sale_date", "1996-01-01"))
    return flt.page(rows, "quantity", ["sales_id"], 3, 50, descending=True, allowed=SALES_SORTS)


@job(
    "f5_fallback_sort",
    with_views("dp_sales", then="SELECT sales_id, sale_date, quantity FROM dp_sales ORDER BY sale_date NULLS LAST, sales_id LIMIT 25"),
)
def f5_fallback(spark, sf_dir):
    """A sort column outside the list falls back to the date."""
    rows = star.sales_flat(spark, sf_dir, ["sales_id", "sale_date", "quantity"])
    return flt.page(rows, "customer; --", ["sales_id"], 1, 25, allowed=SALES_SORTS, fallback="sale_date")


@job(
    "f5_page_info",
    "SELECT count(*) AS total_count, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50) AS has_next, TRUE AS has_previous FROM lineitem",
)
def f5_info(spark, sf_dir):
    return flt.page_info(star.sales_flat(spark, sf_dir, ["sale_date"]), 3, 50)


@job(
    "f6_dimension_page",
    with_views(
        "dp_sales", "dp_master",
        then="""
SELECT m.product, m.customer, m.location, sale_date, quantity, sales_id FROM dp_sales s JOIN dp_master m ON s.master_id = m.master_id
JOIN (SELECT DISTINCT product, customer, location FROM dp_master ORDER BY product, customer, location LIMIT 20 OFFSET 20) p
  ON m.product = p.product AND m.customer = p.customer AND m.location = p.location""",
    ),
)
def f6(spark, sf_dir):
    """Second page of dimension rows with all their facts. A page has at most its size in rows."""
    cols = ["product", "customer", "location"]
    flat = star.sales_flat(spark, sf_dir, [*cols, "sale_date", "quantity", "sales_id"])
    page = combinations_at(flat, cols).orderBy(*cols).offset(20).limit(20)
    return flat.join(F.broadcast(page), cols)


@job(
    "f7_master_page",
    with_views(
        "dp_master",
        then="SELECT * FROM dp_master WHERE product IN ('Brand#12', 'Brand#13') AND customer = 'BUILDING' ORDER BY location DESC NULLS LAST, master_id LIMIT 40 OFFSET 40",
    ),
)
def f7(spark, sf_dir):
    rows = star.master(spark, sf_dir).where(flt.dimension_filter({"product": ["Brand#12", "Brand#13"], "customer": "BUILDING"}))
    return flt.page(rows, "location", ["master_id"], 2, 40, descending=True, allowed=star.DIMS, fallback="product")


_SELECTED = {"product": ["Brand#11", "Brand#12"], "customer": ["BUILDING"], "location_region": ["ASIA", "EUROPE"], "product_group": []}


@job(
    "f8_facet",
    with_views(
        "dp_master",
        then="SELECT nullif(customer, 'FURNITURE') AS value, count(*) AS value_count, coalesce(nullif(customer, 'FURNITURE'), 'NULL') AS display_value FROM dp_master "
        "WHERE product IN ('Brand#11', 'Brand#12') AND location_region IN ('ASIA', 'EUROPE') GROUP BY ALL",
    ),
)
def f8(spark, sf_dir):
    """The field's own selection is ignored; a missing value shows as NULL."""
    dims = star.master(spark, sf_dir).withColumn("customer", F.nullif("customer", F.lit("FURNITURE")))
    return flt.facet(dims, "customer", _SELECTED)


def _f9_sql():
    def other(field):
        parts = [f"{k} IN (" + ", ".join(f"'{v}'" for v in vs) + ")" for k, vs in _SELECTED.items() if vs and k != field]
        return f"SELECT '{field}' AS field, {field} AS value, count(*) AS value_count FROM dp_master WHERE {' AND '.join(parts)} GROUP BY ALL"

    return with_views("dp_master", then=" UNION ALL ".join(other(f) for f in _SELECTED))


@job("f9_all_facets", _f9_sql())
def f9(spark, sf_dir):
    return flt.facets(star.master(spark, sf_dir), _SELECTED)


_FIELDS = ["product", "customer", "location"]


@job(
    "f11_insert_absent",
    with_views(
        "dp_flat",
        then=f"""
, old AS (SELECT DISTINCT {nk_sql(*_FIELDS)} AS master_id, product, customer, location FROM (
    SELECT product, nullif(customer, 'FURNITURE') AS customer, location FROM dp_flat WHERE location_region <> 'AFRICA')),
inc AS (SELECT DISTINCT product, nullif(customer, 'FURNITURE') AS customer, location FROM dp_flat)
SELECT * FROM old UNION ALL
SELECT {nk_sql(*_FIELDS)}, product, customer, location FROM inc i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.product IS NOT DISTINCT FROM i.product
  AND o.customer IS NOT DISTINCT FROM i.customer AND o.location IS NOT DISTINCT FROM i.location)""",
    ),
)
def f11(spark, sf_dir):
    """Empty customer texts arrive as NULL and match the NULL rows already there."""
    flat = star.sales_flat(spark, sf_dir, [*_FIELDS, "location_region"])
    none = F.nullif("customer", F.lit("FURNITURE"))
    old = flat.where("location_region <> 'AFRICA'").withColumn("customer", none).select(*_FIELDS).distinct()
    old = old.select(natural_key(_FIELDS).alias("master_id"), *_FIELDS)
    incoming = flat.withColumn("customer", F.coalesce(none, F.lit(""))).select(*_FIELDS)
    return up.insert_absent(old, incoming, _FIELDS, "master_id")


# ---------------------------------------------------------------- runs, versions, schedules

# Orders play the forecast runs: one run per order, filters in JSON, status from the order.
add_view(
    "dp_runs",
    """
SELECT 'run-' || o_orderkey AS run_id, o_orderkey, c_mktsegment AS customer, CASE WHEN o_orderkey % 4 = 0 THEN 'WEEKLY' ELSE 'MONTHLY' END AS run_interval,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Running' ELSE 'Pending' END AS status, o_orderpriority AS version_id, o_custkey,
  CAST(o_orderdate AS DATE) AS created_on, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey""",
)


def runs(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders")
    c = star.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    df = o.join(c, o.o_custkey == c.c_custkey)
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Pending")
    interval = F.when(F.col("o_orderkey") % 4 == 0, "WEEKLY").otherwise("MONTHLY")
    filters = F.to_json(F.struct(F.col("c_mktsegment").alias("customer"), F.lit("customer").alias("aggregation_level"), interval.alias("interval")))
    return df.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), filters.alias("forecast_filters"), status.alias("status"),
        F.col("o_orderpriority").alias("version_id"), F.col("o_orderdate").cast("date").alias("created_on"),
        F.col("o_orderdate").alias("created_at"), "o_orderkey", "o_custkey",
    )


def versions(spark):
    """Seeded planning versions: a fixed handful of rows."""
    rows = [("1-URGENT", "Baseline"), ("2-HIGH", "Baseline"), ("3-MEDIUM", "Scenario"), ("4-NOT SPECIFIED", "Scenario"), ("5-LOW", "Scenario")]
    return spark.createDataFrame(rows, "version_id string, version_type string")


_VERSIONS_SQL = (
    ", ver(version_id, version_type) AS (VALUES ('1-URGENT', 'Baseline'), ('2-HIGH', 'Baseline'), ('3-MEDIUM', 'Scenario'), "
    "('4-NOT SPECIFIED', 'Scenario'), ('5-LOW', 'Scenario'))"
)


@job(
    "f12_matching_runs",
    with_views(
        "dp_runs",
        then=_VERSIONS_SQL + """
SELECT run_id, r.version_id, version_type, created_on FROM dp_runs r JOIN ver ON r.version_id = ver.version_id
WHERE customer = 'BUILDING' AND run_interval = 'MONTHLY' AND status = 'Completed'""",
    ),
)
def f12(spark, sf_dir):
    """Completed runs of an entity by the fields of their filter JSON."""
    entity = {"customer": "BUILDING", "aggregation_level": "customer", "interval": "MONTHLY"}
    hit = flt.all_of([F.get_json_object("forecast_filters", f"$.{k}") == v for k, v in entity.items()])
    rows = runs(spark, sf_dir).where(hit & (F.col("status") == "Completed")).join(versions(spark), "version_id")
    return rows.select("run_id", "version_id", "version_type", "created_on").orderBy(F.col("created_on").desc(), "run_id")


@job(
    "f14_factor_page",
    with_views(
        "dp_factors",
        then="SELECT * FROM dp_factors WHERE factor_name = '2-HIGH' AND factor_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' "
        "ORDER BY factor_date DESC NULLS LAST, factor_name LIMIT 20 OFFSET 20",
    ),
)
def f14(spark, sf_dir):
    """Live factors only; rows before 1996 are soft-deleted."""
    early = F.col("factor_date") < F.lit("1996-01-01").cast("date")
    known = star.factors(spark, sf_dir).withColumn("deleted_at", F.when(early, F.lit("2001-01-01").cast("date")))
    live = known.where(F.col("deleted_at").isNull() & (F.col("factor_name") == "2-HIGH") & flt.date_range("factor_date", "1995-06-01", "2000-12-31"))
    return flt.page(live.drop("deleted_at"), "factor_date", ["factor_name"], 2, 20, descending=True)


@job(
    "f15_run_page",
    with_views(
        "dp_runs",
        then="SELECT run_id, version_id, status, created_on FROM dp_runs WHERE version_id = '1-URGENT' AND status = 'Running' ORDER BY created_on DESC NULLS LAST, run_id LIMIT 30 OFFSET 30",
    ),
)
def f15(spark, sf_dir):
    rows = runs(spark, sf_dir).where("version_id = '1-URGENT' AND status = 'Running'").select("run_id", "version_id", "status", "created_on")
    return flt.page(rows, "created_on", ["run_id"], 2, 30, descending=True)


@job(
    "f15b_schedule_page",
    "SELECT s_suppkey AS schedule_id, s_name AS schedule_name, s_acctbal > 0 AS is_active FROM supplier WHERE s_acctbal > 0 ORDER BY schedule_id DESC LIMIT 20 OFFSET 10",
)
def f15b(spark, sf_dir):
    """Suppliers play the schedules; higher ids are newer."""
    rows = star.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("schedule_id"), F.col("s_name").alias("schedule_name"), (F.col("s_acctbal") > 0).alias("is_active")
    )
    return rows.where("is_active").orderBy(F.col("schedule_id").desc()).offset(10).limit(20)


@job(
    "o6_paired_filters",
    """
WITH c AS (SELECT c_custkey, c_nationkey % 3 AS k, c_mktsegment AS seg, 'N' || c_nationkey AS nat FROM customer),
a AS (SELECT c_custkey, k, CASE k WHEN 0 THEN [seg || '-a', seg || '-b'] WHEN 1 THEN [seg || '-a', seg || '-b', seg || '-c'] ELSE [seg] END AS s,
  [nat || '-x', nat || '-y'] AS n FROM c)
SELECT c_custkey, CAST(p AS INTEGER) AS position, k = 1 AS pooled,
  CASE WHEN k = 0 THEN s[p + 1] ELSE array_to_string(s, ',') END AS customers, CASE WHEN k = 1 THEN array_to_string(n, ',') ELSE n[p + 1] END AS locations
FROM a, range(2) r(p) WHERE k <> 1 OR p = 0""",
)
def o6(spark, sf_dir):
    """Equally long lists pair up, unequal ones stay pooled, a single value is constant."""
    seg, nat, k = F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.col("c_nationkey") % 3
    ends = [F.concat(seg, F.lit(s)) for s in ("-a", "-b", "-c")]
    lists = star.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 0, F.array(*ends[:2])).when(k == 1, F.array(*ends)).otherwise(F.array(seg)).alias("customers"),
        F.array(F.concat(nat, F.lit("-x")), F.concat(nat, F.lit("-y"))).alias("locations"),
    )
    out = flt.paired_filters(lists, ["customers", "locations"])
    return out.select(
        "c_custkey", "position", "pooled", F.array_join("customers", ",").alias("customers"), F.array_join("locations", ",").alias("locations")
    )


# ---------------------------------------------------------------- lookups and reconciliation


@job("c5_latest_attributes", with_views("dp_latest", then="SELECT * FROM dp_latest"))
def c5(spark, sf_dir):
    return latest_prices(spark, sf_dir)


@job(
    "c6_entity_lookup",
    with_views(
        "dp_master",
        then="""
, e AS (SELECT DISTINCT product, CASE WHEN product = 'Brand#11' THEN 'NOWHERE' ELSE location END AS location FROM dp_master),
f AS (SELECT product, location, min(master_id) AS master_id FROM dp_master GROUP BY ALL)
SELECT e.product, e.location, f.master_id, f.master_id IS NULL AS unmatched FROM e LEFT JOIN f ON e.product = f.product AND e.location = f.location""",
    ),
)
def c6(spark, sf_dir):
    """Lowest matching master_id per entity; entities without one are reported."""
    dims = star.sales_flat(spark, sf_dir, ["product", "location", "master_id"])
    place = F.when(F.col("product") == "Brand#11", "NOWHERE").otherwise(F.col("location"))
    entities = dims.select("product", place.alias("location")).distinct()
    return up.resolve_master(entities, dims, ["product", "location"]).withColumn("unmatched", F.col("master_id").isNull())


add_view("dp_left", "SELECT c_custkey AS k, c_mktsegment AS role, c_acctbal > 0 AS active FROM customer")
add_view(
    "dp_right",
    """
SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'GUEST' ELSE c_mktsegment END AS role, c_acctbal > 0 AS active FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT c_custkey + 100000000, c_mktsegment, TRUE FROM customer WHERE c_custkey % 25 = 0""",
)


def two_copies(spark, sf_dir):
    """A source of truth, and a copy that misses rows, has extra ones and holds stale values."""
    c = star.table(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    stale = left.where("k % 10 <> 3").withColumn("role", F.when(F.col("k") % 7 == 0, "GUEST").otherwise(F.col("role")))
    extra = left.where("k % 25 = 0").select((F.col("k") + 100000000).alias("k"), "role", F.lit(True).alias("active"))
    return left, stale.unionByName(extra)


@job(
    "c8_table_diff",
    with_views(
        "dp_left", "dp_right",
        then="""
SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'extra'
  WHEN l.role = r.role AND l.active = r.active THEN 'same' ELSE 'mismatched' END AS status FROM dp_left l FULL JOIN dp_right r ON l.k = r.k""",
    ),
)
def c8(spark, sf_dir):
    return up.table_diff(*two_copies(spark, sf_dir), ["k"], ["role", "active"]).drop("_l", "_r")


@job(
    "c10_repair",
    with_views(
        "dp_left", "dp_right",
        then="""
SELECT coalesce(l.k, r.k) AS k, coalesce(l.role, r.role) AS role, coalesce(l.active, r.active) AS active,
  l.k IS NOT NULL AND (r.k IS NULL OR l.role <> r.role OR l.active <> r.active) AS repaired FROM dp_left l FULL JOIN dp_right r ON l.k = r.k""",
    ),
)
def c10(spark, sf_dir):
    return up.repair(*two_copies(spark, sf_dir), ["k"], ["role", "active"])


@job(
    "c9_update_then_insert",
    with_views(
        "dp_plan", "dp_sales",
        then="""
, inc AS (SELECT master_id, CAST(date_trunc('month', sale_date) AS DATE) + 31 AS d, max(quantity) AS quantity, max(uom) AS uom FROM dp_sales GROUP BY ALL),
old AS (SELECT master_id, plan_date AS d, quantity, 'OLD' AS uom FROM dp_plan WHERE plan_type = 'manual' UNION ALL
        SELECT master_id, plan_date + 31, quantity, 'OLD' FROM dp_plan WHERE plan_type = 'manual')
SELECT coalesce(i.master_id, o.master_id) AS master_id, coalesce(i.d, o.d) AS plan_date, coalesce(i.quantity, o.quantity) AS quantity, coalesce(i.uom, o.uom) AS uom,
  CASE WHEN o.master_id IS NULL THEN 'inserted' WHEN i.master_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM inc i FULL JOIN (SELECT master_id, d, max(quantity) AS quantity, max(uom) AS uom FROM old GROUP BY ALL) o ON i.master_id = o.master_id AND i.d = o.d""",
    ),
)
def c9(spark, sf_dir):
    """Batch collapsed by MAX per key, matched rows updated, the others inserted, old ones kept."""
    keys = ["master_id", "plan_date"]
    sales = star.sales_flat(spark, sf_dir, ["master_id", "sale_date", "quantity", "uom"])
    inc = sales.groupBy("master_id", F.date_add(F.trunc("sale_date", "MM"), 31).alias("plan_date")).agg(
        F.max("quantity").alias("quantity"), F.max("uom").alias("uom")
    )
    manual = star.plan_rows(spark, sf_dir).where("plan_type = 'manual'")
    shifts = F.explode(F.array(F.lit(0), F.lit(31)))
    old = manual.withColumn("s", shifts).select("master_id", F.date_add("plan_date", F.col("s")).alias("plan_date"), "quantity")
    old = old.groupBy(*keys).agg(F.max("quantity").alias("quantity")).withColumn("uom", F.lit("OLD"))
    merged = up.upsert(old.withColumn("action", F.lit("kept")), up.upsert_flags(old, inc, keys), keys)
    return merged.select(*keys, "quantity", "uom", "action")


# ---------------------------------------------------------------- versions and jobs


@job(
    "x7_exclusive_activation",
    with_views(
        "dp_runs",
        then="""
, req AS (SELECT version_id AS kind, max(o_orderkey) AS chosen FROM dp_runs WHERE version_id <> '5-LOW' GROUP BY version_id)
SELECT run_id AS version, version_id AS kind, CASE WHEN chosen IS NULL THEN status = 'Completed' ELSE o_orderkey = chosen END AS is_active
FROM dp_runs LEFT JOIN req ON version_id = kind""",
    ),
)
def x7(spark, sf_dir):
    """Newest version of each requested type turns on, its siblings off; other types keep their state."""
    df = runs(spark, sf_dir).select(
        F.col("run_id").alias("version"), F.col("version_id").alias("kind"), (F.col("status") == "Completed").alias("is_active"), "o_orderkey"
    )
    asked = df.where("kind <> '5-LOW'").groupBy("kind").agg(F.max("o_orderkey").alias("o_orderkey"))
    return pub.activate(df, asked, "kind", "o_orderkey").drop("o_orderkey")


@job(
    "x7b_deletable_versions",
    "SELECT c_custkey AS version_key, c_name AS version_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
def x7b(spark, sf_dir):
    """Customers play the versions, finished orders the runs that hold them."""
    v = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_key"), F.col("c_name").alias("version_name"))
    used = star.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("version_key"))
    return pub.deletable(v, used, "version_key")


add_view(
    "dp_jobs",
    """
SELECT 'job-' || o_orderkey AS job_id, o_orderkey, 'user-' || (o_custkey % 50) AS created_by, o_orderdate AS created_at, o_orderstatus, c_mktsegment, o_custkey,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS forecast_start, CAST(o_custkey % 20 AS INTEGER) AS a1, CAST(o_orderkey % 20 AS INTEGER) AS a2
FROM orders JOIN customer ON o_custkey = c_custkey""",
)


def jobs(spark, sf_dir):
    """Orders play the forecast jobs; every third request names one algorithm, the others list two."""
    o = star.table(spark, sf_dir, "orders")
    c = star.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    df = o.join(c, o.o_custkey == c.c_custkey)
    a1, a2 = (F.col("o_custkey") % 20).cast("int"), (F.col("o_orderkey") % 20).cast("int")
    shared = [
        F.struct(F.col("c_mktsegment").alias("customer")).alias("forecast_filters"),
        F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM-dd").alias("forecast_start"), F.lit("2002-12-31").alias("forecast_end"),
    ]
    one = F.to_json(F.struct(*shared, a1.alias("algorithm_id")))
    many = F.to_json(F.struct(*shared, F.array(F.struct(a1.alias("algorithm_id")), F.struct(a2.alias("algorithm_id"))).alias("algorithms")))
    return df.select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 50).cast("string")).alias("created_by"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, one).otherwise(many).alias("request_data"),
    )


# The algorithm list of a fresh installation.
SEEDED = [
    "ARIMA", "Linear Regression", "Polynomial Regression", "Exponential Smoothing", "Enhanced Exponential Smoothing", "Holt Winters", "Prophet",
    "LSTM Neural Network", "XGBoost", "SVR", "KNN", "Gaussian Process", "Neural Network", "Moving Average", "SARIMA", "Random Forest",
]
_SEEDED_SQL = ", alg(algorithm_id, algorithm_name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SEEDED, 1)) + ")"


@job(
    "x8_job_history",
    with_views(
        "dp_jobs",
        then=_SEEDED_SQL + """
, ids AS (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 OR a1 = a2 THEN [a1] ELSE [a1, a2] END) AS algorithm_id FROM dp_jobs
  WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-12-31')
SELECT job_id, created_by, ids.algorithm_id, algorithm_name, strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') AS created_local FROM ids LEFT JOIN alg ON ids.algorithm_id = alg.algorithm_id""",
    ),
)
def x8(spark, sf_dir):
    """Jobs of a time range with algorithm names and Indian wall time."""
    names = spark.createDataFrame(list(enumerate(SEEDED, 1)), "algorithm_id int, algorithm_name string")
    out = pub.job_history(jobs(spark, sf_dir), names, "Asia/Kolkata", created_from="1996-01-01 00:00:00", created_to="2000-12-31 00:00:00")
    iso = F.date_format("created_local", "yyyy-MM-dd'T'HH:mm:ss").alias("created_local")
    return out.select("job_id", "created_by", "algorithm_id", "algorithm_name", iso)


@job(
    "x8_user_jobs",
    with_views(
        "dp_jobs",
        then=_SEEDED_SQL + """
, j AS (SELECT * FROM dp_jobs WHERE created_by = 'user-7' ORDER BY created_at DESC, job_id LIMIT 20),
ids AS (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 OR a1 = a2 THEN [a1] ELSE [a1, a2] END) AS algorithm_id FROM j)
SELECT job_id, ids.algorithm_id, algorithm_name FROM ids LEFT JOIN alg ON ids.algorithm_id = alg.algorithm_id""",
    ),
)
def x8_user(spark, sf_dir):
    """One user's newest jobs; the limit is the request's."""
    names = spark.createDataFrame(list(enumerate(SEEDED, 1)), "algorithm_id int, algorithm_name string")
    return pub.job_history(jobs(spark, sf_dir), names, user="user-7", limit=20).select("job_id", "algorithm_id", "algorithm_name")


@job(
    "x9_duplicate_running",
    with_views(
        "dp_jobs",
        then="""
, k AS (SELECT *, c_mktsegment || forecast_start || CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE a1 || ',' || a2 END AS rk FROM dp_jobs)
SELECT job_id FROM k WHERE o_orderstatus <> 'O' AND rk IN (SELECT rk FROM k WHERE o_orderstatus = 'O')""",
    ),
)
def x9(spark, sf_dir):
    """Requests equal to one that is still running."""
    df = jobs(spark, sf_dir)
    return pub.duplicate_running(df.where("status <> 'O'"), df.where("status = 'O'")).select("job_id")


_X10_JSON = """'{"user_id":' || user_id || ',"password":"p\\"' || event_id || '","nested":{"Token":' || event_id || ',"k":1},"list":[{"api_key":null,"x":"y"}],"note":"password"}'"""


@job(
    "x10_redacted_payload",
    f"""
SELECT event_id AS log_id, regexp_replace({_X10_JSON}, '"(password|password_hash|token|access_token|refresh_token|authorization|api_key|secret|client_secret)"\\s*:\\s*("(?:[^"\\\\]|\\\\.)*"|-?[0-9][-+0-9.eE]*|true|false|null)',
  '"\\1": "***redacted***"', 'gi') AS payload FROM events""",
)
def x10(spark, sf_dir):
    log = star.request_log(spark, sf_dir)
    body = F.concat(
        F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit(',"password":"p\\"'), F.col("log_id").cast("string"),
        F.lit('","nested":{"Token":'), F.col("log_id").cast("string"), F.lit(',"k":1},"list":[{"api_key":null,"x":"y"}],"note":"password"}'),
    )
    return pub.redact(log.select("log_id", body.alias("payload")), "payload")

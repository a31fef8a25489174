"""The demand-planning star schema, derived from the given tables.

A caller names the columns it wants, and only the tables those columns come from are
joined: the keys are referential, so a join that adds no column adds and drops no row.
Catalyst picks each join strategy from sizes and AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.scalars import period_start

DIMS = ["product", "product_group", "customer", "location", "location_region"]
FACT = ["sales_id", "master_id", "sale_date", "quantity", "uom", "unit_price", "created_at"]

_PART = {"product", "product_group", "master_id"}
_CUSTOMER = {"customer", "master_id"}
_SUPPLIER = {"location", "location_region", "master_id"}
_ORDER = _CUSTOMER | {"created_at"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_flat(spark: SparkSession, sf_dir: str, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """Fact rows with the asked dimension columns; ``extra`` passes raw line columns through."""
    need = set(columns)
    df = table(spark, sf_dir, "lineitem")
    if need & _PART:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
        df = df.join(part, df.l_partkey == part.p_partkey)
    if need & _ORDER:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if need & _CUSTOMER:
            customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
            orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
        df = df.join(orders, df.l_orderkey == orders.o_orderkey)
    if need & _SUPPLIER:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        if "location_region" in need:
            region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
            nation = nation.join(region, nation.n_regionkey == region.r_regionkey)
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        supplier = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey)
    made = {
        "sales_id": lambda: F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        ),
        "master_id": lambda: F.concat_ws("|", "p_brand", "p_type", "c_mktsegment", "n_name"),
        "product": lambda: F.col("p_brand"),
        "product_group": lambda: F.col("p_type"),
        "customer": lambda: F.col("c_mktsegment"),
        "location": lambda: F.col("n_name"),
        "location_region": lambda: F.col("r_name"),
        "sale_date": lambda: F.col("l_shipdate").cast("date"),
        "quantity": lambda: F.col("l_quantity").cast("double"),
        "uom": lambda: F.lit("EA"),
        "unit_price": lambda: F.col("l_extendedprice") / F.col("l_quantity"),
        "created_at": lambda: F.col("o_orderdate").cast("date"),
    }
    return df.select(*[made[c]().alias(c) for c in columns], *extra)


def master(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Dimension rows, one per master_id."""
    return sales_flat(spark, sf_dir, ["master_id", *(columns or DIMS)]).distinct()


def total_with_text(rows: DataFrame, keys: list, quantity: str = "quantity", text: str = "uom") -> DataFrame:
    """Sum of the quantity and highest text per key.

    Rows collapse by hash with the text among the keys; only what is left is sorted for the text.
    """
    fine = rows.groupBy(*keys, text).agg(F.sum(quantity).alias(quantity))
    names = [c for c in fine.columns if c not in (quantity, text)]
    return fine.groupBy(*names).agg(F.sum(quantity).alias(quantity), F.max(text).alias(text))


def plan_rows(spark: SparkSession, sf_dir: str, dims: list[str] = ()) -> DataFrame:
    """Planning table: monthly totals per master, large ones entered by hand.

    Dimension columns hang on master_id, so they ride along as grouping keys.
    """
    rows = sales_flat(spark, sf_dir, ["master_id", *dims, "sale_date", "quantity", "uom"])
    out = total_with_text(rows, ["master_id", *dims, period_start(F.col("sale_date")).alias("plan_date")])
    return with_plan_type(out)


def with_plan_type(plan: DataFrame) -> DataFrame:
    return plan.withColumn("plan_type", F.when(F.col("quantity") > 60, "manual").otherwise("disaggregated"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long external-factor series: mean order value per priority and month."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("factor_name"),
        period_start(F.col("o_orderdate").cast("date")).alias("factor_date"),
    ).agg(F.round(F.avg("o_totalprice"), 2).alias("factor_value"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("event_type").alias("operation"),
        F.col("ts").alias("start_time"),
        F.col("value").alias("duration_seconds"),
        F.col("props").alias("payload"),
        "user_id",
    )

"""Ingestion jobs. The landed sheets, ERP responses and factor sheets are the star rows with
typical dirt put in by fixed rules on the order key; every row of the tables takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.functions.scalars import erp_date, natural_key, period_start, table_name
from demandloom.operators import upsert as up
from demandloom.operators.filters import condition, erp_filter
from demandloom.operators.publish import number_rows, wide_dashboard
from demandloom.operators.totals import first_rows
from demandloom.plans import star
from demandloom.plans.registry import job
from demandloom.plans.twins import add_view, with_views
from demandloom.session import scratch_folder
from demandloom.sources import landing as src
from demandloom.sources import months
from demandloom.sources.catalogue import Catalogue, typed_load

META = ["upload_id", "row_no", "sales_id"]
SHEET = {
    " Product ": "product", "Product Group": "product_group", "Customer": "customer", " Location": "location",
    "Location Region": "location_region", "Sale Date ": "sale_date", "Quantity": "quantity", "UOM": "uom",
    "Price": "price", "Remark": "remark",
}
CATALOGUE = Catalogue.parse(
    {
        "fields": [
            {"field_name": "product", "data_type": "Char", "is_unique_key": True},
            {"field_name": "product_group", "data_type": "Char", "is_characteristic": True},
            {"field_name": "customer", "data_type": "Char", "is_unique_key": True},
            {"field_name": "location", "data_type": "Char", "is_unique_key": True},
            {"field_name": "location_region", "data_type": "Char", "is_characteristic": True, "parent_field_name": "location"},
            {"field_name": "sale_date", "data_type": "Date", "is_date_field": True},
            {"field_name": "quantity", "data_type": "Decimal", "is_target_variable": True},
        ]
    }
)

# ---------------------------------------------------------------- landed sheet


def _every(k: int) -> Column:
    return F.col("l_orderkey") % k == 0


def landed(spark, sf_dir, meta: bool = True):
    cols = [*star.DIMS, "sale_date", "quantity", "sales_id"]
    raw = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    df = star.sales_flat(spark, sf_dir, cols, raw)
    text = {
        "product": F.when(_every(2), F.concat(F.lit("  "), "product", F.lit(" "))).otherwise(F.col("product")),
        "product_group": F.col("product_group"),
        "customer": F.when(_every(29), "NaN").otherwise(F.col("customer")),
        "location": F.col("location"),
        "location_region": F.when(_every(37), "none").otherwise(F.col("location_region")),
        "sale_date": F.when(_every(13), "").when(_every(19), "not a date").otherwise(F.col("sale_date").cast("string")),
        "quantity": F.when(_every(7), "n/a").when(_every(11), F.concat(F.lit("-"), F.col("quantity").cast("int").cast("string")))
        .when(_every(17), "  ").otherwise(F.col("quantity").cast("int").cast("string")),
        "uom": F.when(_every(5), " a unit name that is far too long ").when(_every(3), "None").otherwise("EA"),
        "price": F.when(_every(23), "free").otherwise(F.col("l_extendedprice").cast("string")),
        "remark": F.concat(F.lit("line "), F.col("l_linenumber").cast("string")),
    }
    empty = _every(31)
    rows = df.select(
        F.concat(F.lit("upload-"), F.col("l_suppkey").cast("string")).alias("upload_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), "sales_id",
        *[F.when(~empty, text[name]).alias(header) for header, name in SHEET.items()],
    )
    return rows


add_view(
    "dp_landed",
    """
SELECT 'upload-' || l_suppkey AS upload_id, l_orderkey * 10 + l_linenumber AS row_no, sales_id,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN '  ' || product || ' ' ELSE product END END AS product,
  CASE WHEN l_orderkey % 31 <> 0 THEN product_group END AS product_group,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 29 = 0 THEN 'NaN' ELSE customer END END AS customer,
  CASE WHEN l_orderkey % 31 <> 0 THEN location END AS location,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 37 = 0 THEN 'none' ELSE location_region END END AS location_region,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN 'not a date' ELSE CAST(sale_date AS VARCHAR) END END AS sale_date,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' WHEN l_orderkey % 11 = 0 THEN '-' || CAST(quantity AS INTEGER)
       WHEN l_orderkey % 17 = 0 THEN '  ' ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END END AS quantity,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN ' a unit name that is far too long ' WHEN l_orderkey % 3 = 0 THEN 'None' ELSE 'EA' END END AS uom,
  CASE WHEN l_orderkey % 31 <> 0 THEN CASE WHEN l_orderkey % 23 = 0 THEN 'free' ELSE CAST(l_extendedprice AS VARCHAR) END END AS price,
  CASE WHEN l_orderkey % 31 <> 0 THEN 'line ' || l_linenumber END AS remark
FROM dp_flat""",
    ["dp_flat"],
)
_CLEAN = "CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'null', 'none') THEN trim({c}) END AS {c}"
_CELLS = ["product", "product_group", "customer", "location", "location_region", "sale_date", "quantity", "uom", "price"]
add_view(
    "dp_clean",
    "SELECT upload_id, row_no, sales_id, " + ", ".join(_CLEAN.format(c=c) for c in _CELLS) + " FROM dp_landed WHERE remark IS NOT NULL",
    ["dp_landed"],
)
add_view(
    "dp_valid",
    """
SELECT upload_id, row_no, sales_id, product, product_group, customer, location, location_region, TRY_CAST(sale_date AS DATE) AS date,
  CASE WHEN quantity IS NULL THEN 0 ELSE TRY_CAST(quantity AS DOUBLE) END AS quantity, coalesce(substr(uom, 1, 20), 'EACH') AS uom, TRY_CAST(price AS DOUBLE) AS unit_price,
  concat_ws('; ', CASE WHEN sale_date IS NULL THEN 'Date cannot be empty' WHEN TRY_CAST(sale_date AS DATE) IS NULL THEN 'Invalid date format' END,
    CASE WHEN quantity IS NOT NULL AND TRY_CAST(quantity AS DOUBLE) IS NULL THEN 'Invalid quantity' WHEN TRY_CAST(quantity AS DOUBLE) < 0 THEN 'Quantity cannot be negative' END) AS errors
FROM dp_clean""",
    ["dp_clean"],
)


def mapped(spark, sf_dir):
    sheet = src.clean_sheet(landed(spark, sf_dir), META)
    mapping = src.map_columns([c for c in sheet.columns if c not in META], CATALOGUE)
    return src.apply_mapping(sheet, mapping, META)


def validated(spark, sf_dir):
    df = mapped(spark, sf_dir)
    return src.validate_sales(src.clean_cells(df, [c for c in df.columns if c not in META]))


@job(
    "s1_sheet_rows",
    with_views(
        "dp_landed",
        then="SELECT upload_id, row_no, sales_id, product AS \"Product\", product_group AS \"Product Group\", customer AS \"Customer\", location AS \"Location\", "
        "location_region AS \"Location Region\", sale_date AS \"Sale Date\", quantity AS \"Quantity\", uom AS \"UOM\", price AS \"Price\", remark AS \"Remark\" "
        "FROM dp_landed WHERE remark IS NOT NULL",
    ),
)
def s1(spark, sf_dir):
    return src.clean_sheet(landed(spark, sf_dir), META)


@job(
    "s2_mapped_columns",
    with_views(
        "dp_landed",
        then="SELECT upload_id, row_no, sales_id, product, product_group, customer, location, location_region, sale_date AS date, quantity, uom, price AS unit_price "
        "FROM dp_landed WHERE remark IS NOT NULL",
    ),
)
def s2(spark, sf_dir):
    """Remark matches nothing and is skipped; Price stands for the unit price."""
    return mapped(spark, sf_dir)


@job("s3_clean_cells", with_views("dp_clean", then="SELECT * EXCLUDE (price, sale_date), sale_date AS date, price AS unit_price FROM dp_clean"))
def s3(spark, sf_dir):
    df = mapped(spark, sf_dir)
    return src.clean_cells(df, [c for c in df.columns if c not in META])


@job("s4_validated_rows", with_views("dp_valid", then="SELECT * FROM dp_valid"))
def s4(spark, sf_dir):
    return validated(spark, sf_dir)


@job(
    "s5_dimension_rows",
    with_views("dp_clean", then="SELECT DISTINCT product, product_group, customer, location, location_region FROM dp_clean"),
)
def s5(spark, sf_dir):
    return validated(spark, sf_dir).select(*CATALOGUE.columns).distinct()


def nk_sql(*cols: str) -> str:
    parts = ", '|', ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in cols)
    return f"sha256(concat({parts}))"


_KEYS = ["product", "customer", "location"]
add_view(
    "dp_old_dims",
    f"SELECT {nk_sql(*_KEYS)} AS master_id, product, customer, location, min(product_group) AS product_group, min(location_region) AS location_region "
    "FROM dp_flat WHERE location_region <> 'ASIA' GROUP BY product, customer, location",
    ["dp_flat"],
)
add_view(
    "dp_new_dims",
    f"""
SELECT *, FALSE AS is_new FROM dp_old_dims
UNION ALL
SELECT {nk_sql(*_KEYS)}, product, customer, location, product_group, location_region, TRUE FROM (
  SELECT *, row_number() OVER (PARTITION BY product, customer, location ORDER BY row_no, sales_id) AS rn FROM dp_valid WHERE errors = '') v
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM dp_old_dims o WHERE o.product IS NOT DISTINCT FROM v.product
  AND o.customer IS NOT DISTINCT FROM v.customer AND o.location IS NOT DISTINCT FROM v.location)""",
    ["dp_old_dims", "dp_valid"],
)


def old_dims(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, star.DIMS).where("location_region <> 'ASIA'")
    dims = flat.groupBy(*_KEYS).agg(F.min("product_group").alias("product_group"), F.min("location_region").alias("location_region"))
    return dims.select(natural_key(_KEYS).alias("master_id"), *_KEYS, "product_group", "location_region")


def new_dims(spark, sf_dir):
    rows = src.good_rows(validated(spark, sf_dir)).select(*CATALOGUE.columns, "row_no", "sales_id")
    return up.find_or_create(old_dims(spark, sf_dir), rows, CATALOGUE.unique_keys, ["row_no", "sales_id"], "master_id")


@job("s6_find_or_create", with_views("dp_new_dims", then="SELECT * FROM dp_new_dims"))
def s6(spark, sf_dir):
    return new_dims(spark, sf_dir)


add_view(
    "dp_batch",
    f"""
SELECT master_id, date, quantity, uom, unit_price FROM (
  SELECT *, row_number() OVER (PARTITION BY master_id, date ORDER BY row_no DESC, sales_id DESC) AS rn FROM (
    SELECT {nk_sql(*_KEYS)} AS master_id, date, quantity, uom, unit_price, row_no, sales_id FROM dp_valid WHERE errors = '')) WHERE rn = 1""",
    ["dp_valid"],
)


def batch(spark, sf_dir):
    rows = src.good_rows(validated(spark, sf_dir)).withColumn("master_id", natural_key(_KEYS))
    rows = rows.select("master_id", "date", "quantity", "uom", "unit_price", "row_no", "sales_id")
    return up.last_per_key(rows, ["master_id", "date"], ["row_no", "sales_id"]).drop("row_no", "sales_id")


@job("s7_last_row_wins", with_views("dp_batch", then="SELECT * FROM dp_batch"))
def s7(spark, sf_dir):
    return batch(spark, sf_dir)


add_view(
    "dp_old_sales",
    f"SELECT {nk_sql(*_KEYS)} AS master_id, sale_date AS date, sum(quantity) AS quantity, 'OLD' AS uom, CAST(1 AS DOUBLE) AS unit_price "
    "FROM dp_flat WHERE sale_date < DATE '1998-01-01' GROUP BY product, customer, location, sale_date",
    ["dp_flat"],
)


def old_sales(spark, sf_dir):
    flat = star.sales_flat(spark, sf_dir, [*_KEYS, "sale_date", "quantity"]).where("sale_date < DATE '1998-01-01'")
    rows = flat.groupBy(*_KEYS, "sale_date").agg(F.sum("quantity").alias("quantity"))
    return rows.select(
        natural_key(_KEYS).alias("master_id"), F.col("sale_date").alias("date"), "quantity", F.lit("OLD").alias("uom"),
        F.lit(1.0).alias("unit_price"),
    )


@job(
    "s8_fact_upsert",
    with_views(
        "dp_batch", "dp_old_sales",
        then="SELECT * FROM dp_batch UNION ALL SELECT * FROM dp_old_sales o WHERE NOT EXISTS "
        "(SELECT 1 FROM dp_batch b WHERE b.master_id = o.master_id AND b.date = o.date)",
    ),
)
def s8(spark, sf_dir):
    return up.upsert(old_sales(spark, sf_dir), batch(spark, sf_dir), ["master_id", "date"])


add_view("dp_late_batch", "SELECT * FROM dp_batch WHERE date >= DATE '1997-10-01'", ["dp_batch"])
_LATE = "SELECT DISTINCT date_trunc('month', date) FROM dp_late_batch"


@job(
    "s8_monthly_merge",
    with_views(
        "dp_late_batch", "dp_old_sales",
        then=f"SELECT *, TRUE AS rewritten FROM dp_late_batch UNION ALL SELECT *, date_trunc('month', date) IN ({_LATE}) AS rewritten FROM dp_old_sales o "
        "WHERE NOT EXISTS (SELECT 1 FROM dp_late_batch b WHERE b.master_id = o.master_id AND b.date = o.date)",
    ),
)
def s8_monthly(spark, sf_dir):
    """Sales kept by month: the batch of the late months is merged into the stored table and read back.

    ``rewritten`` tells the months that the merge wrote; all others are still the first version's folders.
    """
    root = scratch_folder(spark)
    first = months.create(old_sales(spark, sf_dir), root, "sales", "date")
    second = months.merge(batch(spark, sf_dir).where("date >= DATE '1997-10-01'"), root, "sales", ["master_id", "date"])
    before, after = (months.months(spark, root, "sales", v) for v in (first, second))
    carried = [m for m, folder in after.items() if before.get(m) == folder]
    return months.read(spark, root, "sales").withColumn("rewritten", ~months.month_of(F.col("date")).isin(carried))


@job(
    "s9_upload_report",
    with_views(
        "dp_valid",
        then="SELECT upload_id, count(*) AS total_rows, count(*) FILTER (errors = '') AS success_count, count(*) FILTER (errors <> '') AS failed_count, "
        "'completed' AS status FROM dp_valid GROUP BY upload_id",
    ),
)
def s9(spark, sf_dir):
    return src.upload_report(validated(spark, sf_dir), "upload_id")


@job(
    "s9_history_page",
    with_views(
        "dp_valid",
        then="SELECT upload_id, count(*) AS total_rows, count(*) FILTER (errors = '') AS success_count, count(*) FILTER (errors <> '') AS failed_count, "
        "'completed' AS status FROM dp_valid GROUP BY upload_id ORDER BY upload_id DESC LIMIT 3 OFFSET 1",
    ),
)
def s9_history(spark, sf_dir):
    """A page of the upload history, newest first; uploads are numbered as they come."""
    return src.upload_report(validated(spark, sf_dir), "upload_id").orderBy(F.col("upload_id").desc()).offset(1).limit(3)


@job(
    "s9_error_rows",
    with_views(
        "dp_valid",
        then="SELECT upload_id, row_no + 2 AS sheet_row, errors, error_no FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY row_no, sales_id) AS error_no "
        "FROM dp_valid WHERE errors <> '') WHERE error_no <= 100",
    ),
)
def s9_errors(spark, sf_dir):
    """The report lists the first hundred bad rows of an upload; the operator gives any number, or all."""
    bad = validated(spark, sf_dir).select("upload_id", "row_no", "sales_id", "errors")
    top = src.error_rows(bad, "upload_id", ["row_no", "sales_id"], 100)
    return top.select("upload_id", (F.col("row_no") + 2).alias("sheet_row"), "errors", F.col("error_no").cast("bigint").alias("error_no"))


@job(
    "s9b_ingest_history",
    "SELECT CAST(o_orderdate AS DATE) AS ingested_on, count(*) AS record_count, count(*) FILTER (o_orderstatus = 'F') AS finished "
    "FROM orders GROUP BY ALL ORDER BY ingested_on DESC LIMIT 20 OFFSET 20",
)
def s9b(spark, sf_dir):
    """Second page of the ingest log, newest first; a log row per day of orders."""
    log = star.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ingested_on")).agg(
        F.count("*").alias("record_count"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")
    )
    return log.orderBy(F.col("ingested_on").desc()).offset(20).limit(20)


@job(
    "s10_preview",
    with_views(
        "dp_clean",
        then="SELECT row_no, product, product_group, customer, location, location_region, sale_date AS date, quantity, uom, price AS unit_price "
        "FROM dp_clean ORDER BY row_no, sales_id LIMIT 10",
    ),
)
def s10(spark, sf_dir):
    df = mapped(spark, sf_dir)
    cells = [c for c in df.columns if c not in META]
    return src.clean_cells(df, cells).orderBy("row_no", "sales_id").limit(10).select("row_no", *cells)


# ---------------------------------------------------------------- ERP

ERP_SCHEMA = "CUSTID string, PRDID string, LOCID string, ACTUALSQTY string, PERIODID3_TSTAMP string, UNITPRICE double, UOMTOID string"


def responses(spark, sf_dir):
    """ERP responses, one per line, in the three envelopes the service uses."""
    df = star.sales_flat(spark, sf_dir, ["product", "customer", "location", "sale_date", "quantity", "sales_id"], ["l_orderkey", "l_extendedprice"])
    days = F.datediff("sale_date", F.lit("1970-01-01").cast("date")).cast("bigint")
    stamp = (
        F.when(_every(3), F.concat(F.lit("/Date("), (days * 86400000).cast("string"), F.lit(")/")))
        .when(_every(13), "soon").otherwise(F.concat(F.col("sale_date").cast("string"), F.lit("T00:00:00")))
    )
    record = F.struct(
        F.when(~_every(29), F.col("customer")).alias("CUSTID"), F.col("product").alias("PRDID"), F.col("location").alias("LOCID"),
        F.when(_every(7), "n/a").when(~_every(11), F.col("quantity").cast("int").cast("string")).alias("ACTUALSQTY"),
        stamp.alias("PERIODID3_TSTAMP"), F.col("l_extendedprice").alias("UNITPRICE"), F.when(_every(5), "CS").alias("UOMTOID"),
    )
    body = F.array(record)
    payload = (
        F.when(F.col("l_orderkey") % 3 == 0, F.to_json(F.struct(F.struct(body.alias("results")).alias("d"))))
        .when(F.col("l_orderkey") % 3 == 1, F.to_json(F.struct(body.alias("value"))))
        .otherwise(F.to_json(F.struct(body.alias("results"))))
    )
    return df.select("sales_id", payload.alias("payload"))


def erp_rows(spark, sf_dir):
    return src.erp_records(responses(spark, sf_dir), ERP_SCHEMA, keep=["sales_id"])


add_view(
    "dp_erp",
    """
SELECT sales_id, CASE WHEN l_orderkey % 29 <> 0 THEN customer END AS "CUSTID", product AS "PRDID", location AS "LOCID",
  CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' WHEN l_orderkey % 11 <> 0 THEN CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS "ACTUALSQTY",
  CASE WHEN l_orderkey % 3 = 0 THEN '/Date(' || CAST(epoch_ms(CAST(sale_date AS TIMESTAMP)) AS VARCHAR) || ')/' WHEN l_orderkey % 13 = 0 THEN 'soon'
       ELSE CAST(sale_date AS VARCHAR) || 'T00:00:00' END AS "PERIODID3_TSTAMP",
  l_extendedprice AS "UNITPRICE", CASE WHEN l_orderkey % 5 = 0 THEN 'CS' END AS "UOMTOID",
  CASE WHEN l_orderkey % 3 <> 0 AND l_orderkey % 13 = 0 THEN NULL ELSE sale_date END AS date,
  CASE WHEN l_orderkey % 7 = 0 THEN 0 WHEN l_orderkey % 11 <> 0 THEN quantity END AS quantity
FROM dp_flat""",
    ["dp_flat"],
)
_ERP_COLS = ["sales_id", "CUSTID", "PRDID", "LOCID", "ACTUALSQTY", "PERIODID3_TSTAMP", "UNITPRICE", "UOMTOID"]
_ERP_SELECT = ", ".join(f'"{c}"' for c in _ERP_COLS)


@job("s11_erp_records", with_views("dp_erp", then=f"SELECT {_ERP_SELECT} FROM dp_erp"))
def s11(spark, sf_dir):
    return erp_rows(spark, sf_dir)


@job(
    "s11_erp_page",
    with_views(
        "dp_erp",
        then='SELECT sales_id, "PRDID", "UNITPRICE" FROM dp_erp WHERE "CUSTID" = \'BUILDING\' ORDER BY "UNITPRICE" DESC, sales_id LIMIT 200 OFFSET 100',
    ),
)
def s11_page(spark, sf_dir):
    """Select, filter, order, skip and top of one request."""
    return src.read_records(
        erp_rows(spark, sf_dir), ["sales_id", "PRDID", "UNITPRICE"], condition("CUSTID", "eq", "BUILDING"),
        [F.col("UNITPRICE").desc(), F.col("sales_id")], skip=100, top=200,
    )


@job(
    "s12_erp_filter",
    with_views(
        "dp_flat",
        then="""
SELECT product, customer, count(*) AS row_count, sum(quantity) AS total_quantity FROM dp_flat
WHERE ((sale_date >= DATE '1996-01-01' AND sale_date < DATE '2000-07-01' AND product <> 'Brand#11')
  AND (quantity > 45 OR location_region IN ('EUROPE', 'ASIA')))
  AND (quantity >= 2 AND quantity <= 49 AND customer IN ('BUILDING', 'FURNITURE')) GROUP BY ALL""",
    ),
)
def s12(spark, sf_dir):
    """Both spellings of a filter: grouped conditions and the field dictionary."""
    flat = star.sales_flat(spark, sf_dir, ["product", "customer", "location_region", "sale_date", "quantity"])
    groups = {
        "and": [("sale_date", "ge", "1996-01-01"), ("sale_date", "lt", "2000-07-01T00:00:00"), ("product", "ne", "Brand#11")],
        "or": [("quantity", "gt", 45), ("location_region", "in", ["EUROPE", "ASIA"])],
    }
    plain = {"quantity": {"ge": 2, "le": 49}, "customer": {"in": ["BUILDING", "FURNITURE"]}}
    rows = flat.where(erp_filter(groups) & erp_filter(plain))
    return rows.groupBy("product", "customer").agg(F.count("*").alias("row_count"), F.sum("quantity").alias("total_quantity"))


@job("s13_erp_dates", with_views("dp_erp", then='SELECT sales_id, "PERIODID3_TSTAMP" AS raw_stamp, date AS parsed_date FROM dp_erp'))
def s13(spark, sf_dir):
    rows = erp_rows(spark, sf_dir)
    return rows.select("sales_id", F.col("PERIODID3_TSTAMP").alias("raw_stamp"), erp_date(F.col("PERIODID3_TSTAMP")).alias("parsed_date"))


_ERP_DIMS = ["customer", "product", "location"]
add_view(
    "dp_split",
    f"""
SELECT {nk_sql('"CUSTID"', '"PRDID"', '"LOCID"')} AS master_id, date, quantity, "UNITPRICE" AS unit_price, coalesce("UOMTOID", 'EA') AS uom, sales_id FROM dp_erp""",
    ["dp_erp"],
)


@job(
    "s14_split_dimensions",
    with_views(
        "dp_erp",
        then=f"SELECT DISTINCT \"CUSTID\" AS customer, \"PRDID\" AS product, \"LOCID\" AS location, {nk_sql(chr(34) + 'CUSTID' + chr(34), chr(34) + 'PRDID' + chr(34), chr(34) + 'LOCID' + chr(34))} AS master_id FROM dp_erp",
    ),
)
def s14_dims(spark, sf_dir):
    dims, _ = src.split_records(erp_rows(spark, sf_dir))
    return dims.withColumn("master_id", natural_key(_ERP_DIMS))


@job(
    "s14_split_facts",
    with_views("dp_split", then="SELECT master_id, date, quantity, unit_price, uom FROM dp_split"),
)
def s14(spark, sf_dir):
    """Facts under the id of their dimension row. The id is a hash of the row, so no join is needed."""
    _, facts = src.split_records(erp_rows(spark, sf_dir))
    return facts.select(natural_key(_ERP_DIMS).alias("master_id"), "date", "quantity", "unit_price", "uom")


add_view(
    "dp_known",
    f"SELECT DISTINCT {nk_sql('customer', 'product', 'location')} AS master_id, customer, product, location, 'known' AS origin FROM dp_flat WHERE location_region <> 'ASIA'",
    ["dp_flat"],
)


def known_dims(spark, sf_dir):
    rows = star.sales_flat(spark, sf_dir, [*_ERP_DIMS, "location_region"]).where("location_region <> 'ASIA'").select(*_ERP_DIMS).distinct()
    return rows.select(natural_key(_ERP_DIMS).alias("master_id"), *_ERP_DIMS, F.lit("known").alias("origin"))


@job(
    "s15_mapped_dimensions",
    with_views(
        "dp_known", "dp_erp",
        then=f"""
, inc AS (SELECT DISTINCT "CUSTID" AS customer, "PRDID" AS product, "LOCID" AS location FROM dp_erp)
SELECT coalesce(k.master_id, {nk_sql('i.customer', 'i.product', 'i.location')}) AS master_id, coalesce(i.customer, k.customer) AS customer,
  coalesce(i.product, k.product) AS product, coalesce(i.location, k.location) AS location,
  CASE WHEN k.master_id IS NULL THEN 'inserted' WHEN i.product IS NULL THEN 'known' ELSE 'updated' END AS origin
FROM inc i FULL JOIN dp_known k ON i.customer IS NOT DISTINCT FROM k.customer AND i.product = k.product AND i.location = k.location""",
    ),
)
def s15_dims(spark, sf_dir):
    """Records that match an existing dimension row update it, the others insert one; either side is read once."""
    incoming, _ = src.split_records(erp_rows(spark, sf_dir))
    old = known_dims(spark, sf_dir).select(F.struct("master_id", *_ERP_DIMS).alias("_old"))
    new = incoming.select(F.struct(natural_key(_ERP_DIMS).alias("master_id"), *_ERP_DIMS).alias("_new"))
    met = old.join(new, [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in _ERP_DIMS], "full")
    origin = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "known").otherwise("updated")
    return met.select(F.coalesce("_old", "_new").alias("_row"), origin.alias("origin")).select("_row.*", "origin")


@job(
    "s15_mapped_facts",
    with_views(
        "dp_known", "dp_split",
        then="""
SELECT master_id, date, quantity, unit_price, uom FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.master_id, date ORDER BY sales_id DESC) AS rn FROM dp_split s JOIN dp_known k ON s.master_id = k.master_id
  WHERE date IS NOT NULL) WHERE rn = 1""",
    ),
)
def s15(spark, sf_dir):
    """Only records of known dimension rows load; fields are typed by their names first."""
    rows = erp_rows(spark, sf_dir)
    typed = src.typed_by_name(rows.withColumn("had_value", F.col("ACTUALSQTY").isNotNull()))
    facts = typed.select(
        F.col("CUSTID").alias("customer"), F.col("PRDID").alias("product"), F.col("LOCID").alias("location"),
        F.col("PERIODID3_TSTAMP").alias("date"),
        F.when(F.col("had_value"), F.coalesce("ACTUALSQTY", F.lit(0.0))).alias("quantity"),
        F.col("UNITPRICE").alias("unit_price"), F.coalesce("UOMTOID", F.lit("EA")).alias("uom"), "sales_id",
    ).where("date IS NOT NULL")
    keyed = src.attach_master(facts, known_dims(spark, sf_dir), _ERP_DIMS).drop(*_ERP_DIMS)
    return up.last_per_key(keyed, ["master_id", "date"], ["sales_id"]).select("master_id", "date", "quantity", "unit_price", "uom")


@job(
    "s16_raw_facts",
    with_views(
        "dp_erp",
        then='SELECT "CUSTID" AS customer, "PRDID" AS product, "LOCID" AS location, date, coalesce(quantity, 0) AS quantity, "UNITPRICE" AS unit_price FROM dp_erp WHERE date IS NOT NULL',
    ),
)
def s16(spark, sf_dir):
    """Raw landing: no separation, undated rows skipped, every failed quantity 0."""
    _, facts = src.split_records(erp_rows(spark, sf_dir))
    rows = facts.where("date IS NOT NULL").withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))
    return rows.select(*_ERP_DIMS, "date", "quantity", "unit_price")


# ---------------------------------------------------------------- factors

add_view(
    "dp_obs",
    """
SELECT o_orderpriority AS factor_name, CAST(o_orderdate AS DATE) AS factor_date, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS factor_value, o_orderkey,
  o_orderkey % 11 <> 0 AS dated FROM orders""",
)


def observation_responses(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders")
    rec = F.struct(
        F.when(F.col("o_orderkey") % 11 == 0, "n.d.").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"),
        F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
    )
    return o.select("o_orderkey", F.col("o_orderpriority").alias("factor_name"), F.to_json(F.struct(F.array(rec).alias("observations"))).alias("payload"))


@job(
    "s17_observations",
    with_views("dp_obs", then="SELECT o_orderkey, factor_name, factor_date, factor_value FROM dp_obs WHERE factor_value IS NOT NULL AND dated"),
)
def s17(spark, sf_dir):
    return src.observations(observation_responses(spark, sf_dir), keep=["o_orderkey", "factor_name"])


add_view(
    "dp_import",
    """
SELECT factor_name, factor_date, factor_value FROM (SELECT *, row_number() OVER (PARTITION BY factor_name, factor_date ORDER BY o_orderkey DESC) AS rn
  FROM dp_obs WHERE factor_value IS NOT NULL AND dated) WHERE rn = 1""",
    ["dp_obs"],
)


def factor_import(spark, sf_dir):
    rows = src.observations(observation_responses(spark, sf_dir), keep=["o_orderkey", "factor_name"])
    return up.last_per_key(rows, ["factor_name", "factor_date"], ["o_orderkey"]).drop("o_orderkey")


@job(
    "s18_factor_import",
    with_views(
        "dp_import", "dp_factors",
        then="""
SELECT factor_name, factor_date, factor_value, 'import' AS source FROM dp_import
UNION ALL SELECT factor_name, factor_date, factor_value, 'known' FROM dp_factors f
WHERE NOT EXISTS (SELECT 1 FROM dp_import i WHERE i.factor_name = f.factor_name AND i.factor_date = f.factor_date)""",
    ),
)
def s18(spark, sf_dir):
    new = factor_import(spark, sf_dir).withColumn("source", F.lit("import"))
    return up.upsert(star.factors(spark, sf_dir).withColumn("source", F.lit("known")), new, ["factor_name", "factor_date"])


@job(
    "s18_import_counts",
    with_views(
        "dp_import", "dp_factors",
        then="""
SELECT i.factor_name, count(*) FILTER (f.factor_name IS NULL) AS inserted_count, count(*) FILTER (f.factor_name IS NOT NULL) AS updated_count
FROM dp_import i LEFT JOIN dp_factors f ON i.factor_name = f.factor_name AND i.factor_date = f.factor_date GROUP BY ALL""",
    ),
)
def s18_counts(spark, sf_dir):
    flagged = up.upsert_flags(star.factors(spark, sf_dir), factor_import(spark, sf_dir), ["factor_name", "factor_date"])
    return flagged.groupBy("factor_name").agg(
        F.count_if(F.col("action") == "inserted").alias("inserted_count"), F.count_if(F.col("action") == "updated").alias("updated_count")
    )


@job(
    "s19_factor_sheet",
    """
WITH cells AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS n,
  CASE WHEN o_orderkey % 13 = 0 THEN 'never' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS v FROM orders)
SELECT o_orderkey, nullif(trim(n), '') AS factor_name, TRY_CAST(d AS DATE) AS factor_date, TRY_CAST(v AS DOUBLE) AS factor_value,
  concat_ws('; ', CASE WHEN trim(n) = '' THEN 'Factor Name is required' END, CASE WHEN TRY_CAST(d AS DATE) IS NULL THEN 'Invalid date' END,
    CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 'Invalid value' END) AS errors FROM cells""",
)
def s19(spark, sf_dir):
    o, k = star.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cells = o.select(
        "o_orderkey", F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("factor_name"),
        F.when(k % 13 == 0, "never").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("factor_date"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("factor_value"),
    )
    return src.validate_factors(cells)


@job(
    "s20_factor_upsert",
    with_views(
        "dp_factors",
        then="""
, new AS (SELECT factor_name, max(factor_date) AS factor_date, CAST(1.5 AS DOUBLE) AS factor_value FROM dp_factors GROUP BY factor_name)
SELECT * FROM new UNION ALL SELECT * FROM dp_factors f WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.factor_name = f.factor_name AND n.factor_date = f.factor_date)""",
    ),
)
def s20(spark, sf_dir):
    """A single new value for the latest month of each factor."""
    known = star.factors(spark, sf_dir)
    new = known.groupBy("factor_name").agg(F.max("factor_date").alias("factor_date")).withColumn("factor_value", F.lit(1.5))
    return up.upsert(known, new, ["factor_name", "factor_date"])


@job(
    "s21_factor_soft_delete",
    with_views(
        "dp_factors",
        then="SELECT *, CASE WHEN factor_name = '5-LOW' THEN DATE '2002-01-01' WHEN factor_date < DATE '1995-06-01' THEN DATE '2001-01-01' END AS deleted_at "
        "FROM (SELECT * FROM dp_factors WHERE NOT (factor_name = '5-LOW' AND factor_date < DATE '1995-06-01')) "
        "UNION ALL SELECT *, DATE '2001-01-01' FROM dp_factors WHERE factor_name = '5-LOW' AND factor_date < DATE '1995-06-01'",
    ),
)
def s21(spark, sf_dir):
    early = F.when(F.col("factor_date") < F.lit("1995-06-01").cast("date"), F.lit("2001-01-01").cast("date"))
    known = star.factors(spark, sf_dir).withColumn("deleted_at", early)
    return up.soft_delete(known, F.col("factor_name") == "5-LOW", F.lit("2002-01-01").cast("date"))


# ---------------------------------------------------------------- tables

@job(
    "s22_typed_load",
    with_views(
        "dp_clean",
        then="""
SELECT row_no, product, product_group, customer, location, location_region, TRY_CAST(sale_date AS DATE) AS sale_date,
  CAST(TRY_CAST(quantity AS DECIMAL(18, 2)) AS DOUBLE) AS quantity,
  concat_ws(',', CASE WHEN sale_date IS NOT NULL AND TRY_CAST(sale_date AS DATE) IS NULL THEN 'sale_date' END,
    CASE WHEN quantity IS NOT NULL AND TRY_CAST(quantity AS DECIMAL(18, 2)) IS NULL THEN 'quantity' END) AS rejected FROM dp_clean""",
    ),
)
def s22(spark, sf_dir):
    """Catalogue types for every cell, with the rejected cells named."""
    df = mapped(spark, sf_dir).withColumnRenamed("date", "sale_date")
    cells = [c for c in df.columns if c not in META]
    out = typed_load(src.clean_cells(df, cells), CATALOGUE, ["row_no"])
    return out.withColumn("quantity", F.col("quantity").cast("double"))


@job(
    "s23_table_names",
    "SELECT p_partkey, CASE WHEN length(n) BETWEEN 1 AND 63 THEN n END AS table_name FROM (SELECT p_partkey, "
    "regexp_replace(regexp_replace(regexp_replace(lower(' Plan - ' || p_name || '/' || p_brand || ' - ' || p_type || '! '), '[\\s\\-]+', '_', 'g'), "
    "'[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g') AS n FROM part)",
)
def s23_names(spark, sf_dir):
    label = F.concat(F.lit(" Plan - "), "p_name", F.lit("/"), "p_brand", F.lit(" - "), "p_type", F.lit("! "))
    return star.table(spark, sf_dir, "part").select("p_partkey", table_name(label).alias("table_name"))


@job(
    "s23_planning_table",
    with_views(
        "dp_flat",
        then=f"""
SELECT {nk_sql('master_id', 'CAST(period AS VARCHAR)')} AS plan_id, master_id, period AS plan_date, quantity, uom, unit_price, 'manual' AS type,
  'product-product_group-customer-location' AS disaggregation_level, 'planner' AS created_by FROM (
  SELECT master_id, CAST(date_trunc('month', sale_date) AS DATE) AS period, sum(quantity) AS quantity, max(uom) AS uom, max(unit_price) AS unit_price FROM dp_flat GROUP BY ALL)""",
    ),
)
def s23(spark, sf_dir):
    """Planning table in the fact's shape with its tracking columns."""
    flat = star.sales_flat(spark, sf_dir, ["master_id", "sale_date", "quantity", "uom", "unit_price"])
    fine = flat.groupBy("master_id", period_start(F.col("sale_date")).alias("plan_date"), "uom").agg(
        F.sum("quantity").alias("quantity"), F.max("unit_price").alias("unit_price")
    )
    rows = fine.groupBy("master_id", "plan_date").agg(F.sum("quantity").alias("quantity"), F.max("uom").alias("uom"), F.max("unit_price").alias("unit_price"))
    return rows.withColumn("_d", F.col("plan_date").cast("string")).select(
        natural_key(["master_id", "_d"]).alias("plan_id"), "master_id", "plan_date", "quantity", "uom", "unit_price",
        F.lit("manual").alias("type"), F.lit("product-product_group-customer-location").alias("disaggregation_level"),
        F.lit("planner").alias("created_by"),
    )


@job("s24_renamed_table", with_views("dp_plan", then="SELECT master_id, plan_date AS sale_date, quantity AS order_quantity, uom, plan_type FROM dp_plan"))
def s24(spark, sf_dir):
    """Fixed column names moved to the catalogue's names."""
    return star.plan_rows(spark, sf_dir).withColumnsRenamed({"plan_date": "sale_date", "quantity": "order_quantity"})


MONTHS = [f"1998-{m:02d}" for m in range(1, 13)]


@job(
    "s25_wide_export",
    with_views(
        "dp_sales", "dp_plan",
        then="""
, u AS (SELECT master_id, 'Sales history' AS series, sale_date AS d, uom, quantity FROM dp_sales
        UNION ALL SELECT master_id, 'Final plan', plan_date, uom, quantity FROM dp_plan),
g AS (SELECT master_id, series, min(uom) AS uom, """
        + ", ".join(f"sum(CASE WHEN strftime(d, '%Y-%m') = '{m}' THEN quantity END) AS m_{m.replace('-', '_')}" for m in MONTHS)
        + """ FROM u WHERE strftime(d, '%Y') = '1998' GROUP BY master_id, series)
SELECT row_number() OVER (ORDER BY master_id, series) AS s_no, * FROM g""",
    ),
)
def s25(spark, sf_dir):
    """Months as columns, numbered in order; the month list comes from the request."""
    sales = star.sales_flat(spark, sf_dir, ["master_id", "sale_date", "uom", "quantity"]).select(
        "master_id", F.lit("Sales history").alias("series"), F.col("sale_date").alias("d"), "uom", "quantity"
    )
    plan = star.plan_rows(spark, sf_dir).select("master_id", F.lit("Final plan").alias("series"), F.col("plan_date").alias("d"), "uom", "quantity")
    wide = wide_dashboard(sales.unionByName(plan), ["master_id"], "series", "d", MONTHS)
    return number_rows(wide, ["master_id", "series"], "s_no")

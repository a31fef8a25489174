"""Reading, cleaning and validating landed data; shaping it into dimension and fact rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.scalars import clean_text, erp_date, iso_date, to_date, to_number
from demandloom.operators.publish import number_rows
from demandloom.operators.totals import first_rows
from demandloom.sources.catalogue import Catalogue

# Header names a sheet may use for the date and the price.
DATE_HEADERS = ["date", "sales_date", "transaction_date", "period"]
PRICE_HEADERS = ["unit_price", "price", "unitprice"]

# ERP field names and the columns they fill by default.
ERP_DIMENSIONS = {"CUSTID": "customer", "PRDID": "product", "LOCID": "location"}
ERP_FACT = {"ACTUALSQTY": "quantity", "PERIODID3_TSTAMP": "date", "UNITPRICE": "unit_price"}


# ---------------------------------------------------------------- files


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Landed rows as text. CSV cells stay text, so nothing is lost to type guessing.

    ``multi_line`` allows line breaks inside quoted cells; a file is then read by one task.
    """
    if fmt == "csv":
        return spark.read.option("header", True).option("multiLine", multi_line).csv(path)
    if fmt == "json":
        return spark.read.option("primitivesAsString", True).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {fmt}")


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def clean_sheet(df: DataFrame, meta: Sequence[str] = ()) -> DataFrame:
    """Trimmed headers, no all-null rows, at least two columns. ``meta`` columns do not count."""
    data = [c for c in df.columns if c not in meta]
    if len(data) < 2:
        raise ValueError("a sheet needs at least two columns")
    kept = df.dropna("all", subset=[f"`{c}`" for c in data])
    return kept.toDF(*[c if c in meta else c.strip() for c in df.columns])


# ---------------------------------------------------------------- column roles


def header_key(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def map_columns(columns: Sequence[str], catalogue: Catalogue) -> dict[str, dict[str, str | None]]:
    """Role of each sheet column: ``sales`` (target, date, uom, unit_price), ``dims`` and ``skipped``."""
    by_key = {header_key(c): c for c in columns}
    target, date = by_key.get(header_key(catalogue.target)), by_key.get(header_key(catalogue.date))
    if target is None:
        raise ValueError(f"target column {catalogue.target} not found")
    date = date or next((by_key[p] for p in DATE_HEADERS if p in by_key), None)
    if date is None:
        raise ValueError(f"date column {catalogue.date} not found")
    price = next((by_key[p] for p in PRICE_HEADERS if p in by_key), None)
    sales = {"target": target, "date": date, "uom": by_key.get("uom"), "unit_price": price}
    used = {c for c in sales.values() if c}
    known = {header_key(c): c for c in catalogue.columns}
    rest = [c for c in columns if c not in used]
    dims = {known[header_key(c)]: c for c in rest if header_key(c) in known}
    return {"sales": sales, "dims": dims, "skipped": {c: None for c in rest if c not in dims.values()}}


def apply_mapping(df: DataFrame, mapping: Mapping[str, Mapping[str, str | None]], meta: Sequence[str] = ()) -> DataFrame:
    """Canonical text columns ``date, quantity, uom, unit_price`` and the dimensions."""
    names = {"target": "quantity", "date": "date", "uom": "uom", "unit_price": "unit_price"}

    def pick(source: str | None, name: str) -> Column:
        return (F.col(f"`{source}`") if source else F.lit(None)).cast("string").alias(name)

    return df.select(
        *meta, *[pick(src, dim) for dim, src in mapping["dims"].items()],
        *[pick(mapping["sales"][role], name) for role, name in names.items()],
    )


def clean_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


# ---------------------------------------------------------------- validation


# Error texts of the upload report, and how many characters a unit may have.
NO_DATE, BAD_DATE = "Date cannot be empty", "Invalid date format"
BAD_QUANTITY, NEGATIVE_QUANTITY = "Invalid quantity", "Quantity cannot be negative"
UNIT_CHARS = 20


def validate_sales(df: DataFrame, unit_chars: int | None = UNIT_CHARS, day_first: bool = False) -> DataFrame:
    """Typed fact columns next to an ``errors`` text, empty for good rows.

    Validation looks at one row at a time, so a batch never has to fail as a whole. Unit texts are
    cut to ``unit_chars`` characters, the width of the unit column (None: as they are). ``day_first``
    reads 03/04/2024 as the third of April.
    """
    date = to_date(F.col("date"), day_first)
    qty = F.when(F.col("quantity").isNull(), F.lit(0.0)).otherwise(to_number(F.col("quantity")))
    errors = F.concat_ws(
        "; ",
        F.when(F.col("date").isNull(), NO_DATE).when(F.col("_d").isNull(), BAD_DATE),
        F.when(F.col("_q").isNull(), BAD_QUANTITY).when(F.col("_q") < 0, NEGATIVE_QUANTITY),
    )
    df = df.withColumns({"_d": date, "_q": qty})
    unit = F.col("uom") if unit_chars is None else F.substring("uom", 1, unit_chars)
    return df.withColumns(
        {
            "errors": errors,
            "date": F.col("_d"),
            "quantity": F.col("_q"),
            "uom": F.coalesce(unit, F.lit("EACH")),
            "unit_price": to_number(F.col("unit_price")),
        }
    ).drop("_d", "_q")


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.where("errors = ''").drop("errors")


def upload_report(validated: DataFrame, upload: str) -> DataFrame:
    """Counts per upload, one history row each."""
    bad = F.col("errors") != ""
    return validated.groupBy(upload).agg(
        F.count("*").alias("total_rows"), F.count_if(~bad).alias("success_count"), F.count_if(bad).alias("failed_count"),
        F.lit("completed").alias("status"),
    )


def error_rows(validated: DataFrame, upload: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """Bad rows of each upload with ``error_no`` from 1 in row order; all of them, or the first ``most``.

    All of them are numbered over the whole sorted table first, less the number before their upload's
    first row, so an upload of any size is spread over tasks.
    """
    bad = validated.where("errors <> ''")
    if most is not None:
        return first_rows(bad, [upload], [F.col(c) for c in order], most, "error_no")
    numbered = number_rows(bad, [upload, *order], "_n")
    firsts = numbered.groupBy(F.col(upload).alias("_up")).agg(F.min("_n").alias("_first"))
    out = numbered.join(firsts, F.col(upload).eqNullSafe(F.col("_up")))
    return out.withColumn("error_no", (F.col("_n") - F.col("_first") + 1).cast("int")).drop("_n", "_up", "_first")


# ---------------------------------------------------------------- ERP records


def erp_records(df: DataFrame, schema: str, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Records of landed responses, whichever envelope they came in."""
    rows = f"array<struct<{schema}>>"
    parsed = F.from_json(payload, f"d struct<results {rows}>, value {rows}, results {rows}")
    opened = df.select(*keep, parsed.alias("j"))
    return opened.select(*keep, F.explode(F.coalesce("j.d.results", "j.value", "j.results")).alias("r")).select(*keep, "r.*")


def read_records(
    df: DataFrame, select: Sequence[str] | None = None, where: Column | None = None,
    order_by: Sequence[Column] = (), skip: int | None = None, top: int | None = None,
) -> DataFrame:
    out = df.where(where) if where is not None else df
    if order_by:
        out = out.orderBy(*order_by)
    if skip:
        out = out.offset(skip)
    if top is not None:
        out = out.limit(top)
    return out.select(*select) if select else out


def typed_by_name(df: DataFrame) -> DataFrame:
    """Types from field names: stamps and dates, quantities, the rest text."""

    def typed(name: str) -> Column:
        low = name.lower()
        if low.endswith("_tstamp") or "date" in low:
            return erp_date(F.col(name).cast("string"))
        if low.endswith("qty") or "quantity" in low:
            return to_number(F.col(name).cast("string"))
        return F.col(name)

    return df.select(*[typed(c).alias(c) for c in df.columns])


def split_records(
    df: DataFrame, dims: Mapping[str, str] = ERP_DIMENSIONS, fact: Mapping[str, str] = ERP_FACT, uom: str = "EA",
) -> tuple[DataFrame, DataFrame]:
    """Distinct dimension rows, and fact rows that still carry their dimension columns.

    A quantity that does not parse is 0; a missing one stays missing.
    """
    qty = next(s for s, t in fact.items() if t == "quantity")
    date = next(s for s, t in fact.items() if t == "date")
    price = next((s for s, t in fact.items() if t == "unit_price"), None)
    named = [F.col(s).cast("string").alias(t) for s, t in dims.items()]
    quantity = F.when(F.col(qty).isNotNull(), F.coalesce(to_number(F.col(qty).cast("string")), F.lit(0.0)))
    facts = df.select(
        *named, erp_date(F.col(date).cast("string")).alias("date"), quantity.alias("quantity"),
        (to_number(F.col(price).cast("string")) if price else F.lit(None).cast("double")).alias("unit_price"),
        (F.coalesce(F.col("UOMTOID"), F.lit(uom)) if "UOMTOID" in df.columns else F.lit(uom)).alias("uom"),
    )
    return df.select(*named).distinct(), facts


def attach_master(facts: DataFrame, dims: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fact rows with the master_id of their NULL-safe match; rows without one are skipped."""
    first = dims.groupBy(*[F.col(c).alias(f"_d_{c}") for c in cols]).agg(F.min("master_id").alias("master_id"))
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return facts.join(first, cond).drop(*[f"_d_{c}" for c in cols])


# ---------------------------------------------------------------- observations and factors


def observations(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ("factor_name",)) -> DataFrame:
    """Economic observations of landed responses; missing values (``.``) and bad dates drop out."""
    parsed = F.from_json(payload, "observations array<struct<date string, value string>>")
    rows = df.select(*keep, F.explode(parsed["observations"]).alias("o"))
    out = rows.select(*keep, iso_date(F.col("o.date")).alias("factor_date"), to_number(F.col("o.value")).alias("factor_value"))
    return out.where("factor_date IS NOT NULL AND factor_value IS NOT NULL")


def validate_factors(df: DataFrame) -> DataFrame:
    """Factor sheet cells to typed rows with an ``errors`` text."""
    name, date = clean_text(F.col("factor_name")), to_date(F.col("factor_date"))
    value = to_number(F.col("factor_value"))
    errors = F.concat_ws(
        "; ", F.when(name.isNull(), "Factor Name is required"), F.when(date.isNull(), "Invalid date"),
        F.when(value.isNull(), "Invalid value"),
    )
    return df.withColumns(
        {"errors": errors, "factor_name": name, "factor_date": date, "factor_value": value}
    )

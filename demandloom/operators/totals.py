"""Aggregations of the fact by period and dimension level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.scalars import period_start
from demandloom.operators.filters import date_range, dimension_filter


def level_columns(level: str | Sequence[str], known: Sequence[str]) -> list[str]:
    """Columns of a level given as a list or as ``a-b`` text."""
    parts = [p.strip() for p in level.split("-")] if isinstance(level, str) else list(level)
    unknown = [p for p in parts if p not in known]
    if not parts or unknown:
        raise ValueError(f"unknown level fields {unknown}")
    return parts


def period_totals(
    flat: DataFrame, by: Sequence[str], interval: str = "MONTHLY", *, date: str = "sale_date",
    target: str = "quantity", price: str | None = "unit_price", filters: Mapping[str, Any] | None = None,
    start: str | None = None, end: str | None = None, legacy_daily: bool = False, id_column: str = "sales_id",
    id_is_key: bool = True,
) -> DataFrame:
    """Demand per period and level.

    The fact's id is its primary key, so its distinct count is a row count and everything
    here combines on the map side. Pass ``id_is_key=False`` where ids can repeat.
    """
    rows = flat.where(dimension_filter(filters) & date_range(date, start, end))
    count = F.count("*") if id_is_key else F.count_distinct(id_column)
    aggs = [F.sum(target).alias("total_quantity"), count.alias("transaction_count")]
    if price:
        aggs.append(F.avg(price).alias("avg_price"))
    return rows.groupBy(*by, period_start(F.col(date), interval, legacy_daily).alias("period")).agg(*aggs)


def combinations_at(df: DataFrame, cols: Sequence[str], filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Distinct entities at a level."""
    return df.where(dimension_filter(filters)).select(*cols).distinct()


def offered_levels(fields: Sequence[str], pairs: int | None = None, triples: int | None = None) -> list[tuple[str, ...]]:
    """Every single field, pair and triple; a caller's menu may show only so many pairs and triples."""
    return [
        *combinations(fields, 1), *list(combinations(fields, 2))[:pairs], *list(combinations(fields, 3))[:triples]
    ]


def all_levels(flat: DataFrame, fields: Sequence[str], target: str = "quantity", levels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Totals at every offered level at once, or at the given ones.

    Rows collapse to the finest level first; the grouping sets then expand only that.
    """
    fine = flat.groupBy(*fields).agg(F.sum(target).alias("q"), F.count("*").alias("c"))
    levels = levels or offered_levels(fields)
    sets = [[F.col(f) for f in level] for level in levels]
    rolled = fine.groupingSets(sets, *[F.col(f) for f in fields]).agg(
        F.sum("q").alias("total_quantity"), F.sum("c").alias("transaction_count"),
        *[F.grouping(f).alias(f"_g_{f}") for f in fields],
    )
    used = F.array(*[F.when(F.col(f"_g_{f}") == 0, F.lit(f)) for f in fields])
    entity = F.array(*[F.when(F.col(f"_g_{f}") == 0, F.coalesce(F.col(f), F.lit("NULL"))) for f in fields])
    return rolled.select(
        F.array_join(F.array_compact(used), "-").alias("level_name"),
        F.array_join(F.array_compact(entity), "|").alias("entity"),
        "total_quantity", "transaction_count",
    )


def tagged_totals(tables: Mapping[str, tuple[DataFrame, str]], by: Sequence[str], uom: bool = True) -> DataFrame:
    """Sum per group and date of several tables, one branch each; ``name -> (rows, date column)``."""
    out = None
    for name, (df, date) in tables.items():
        total, when = F.sum("quantity").alias("quantity"), F.col(date).alias("row_date")
        # The highest text needs a sort: rows collapse by hash first, with the text among the keys.
        part = df.groupBy(*by, when, *["uom"] * uom).agg(total)
        if uom:
            part = part.groupBy(*by, "row_date").agg(total, F.max("uom").alias("uom"))
        part = part.withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sales_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("record_count"), F.sum("quantity").alias("total_quantity"),
        F.avg("quantity").alias("avg_quantity"), F.avg("unit_price").alias("avg_price"),
        F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"),
    )


def field_summaries(flat: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Count and quantity per value of each field. Collapses to the finest level before fanning out."""
    fine = flat.groupBy(*fields).agg(F.count("*").alias("c"), F.sum("quantity").alias("q"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        fine.select(F.explode(pairs).alias("e"), "c", "q")
        .groupBy("e.field", "e.value")
        .agg(F.sum("c").alias("record_count"), F.sum("q").alias("total_quantity"))
    )


def factor_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("factor_name").agg(
        F.min("factor_date").alias("first_date"), F.max("factor_date").alias("last_date"),
        F.count("*").alias("record_count"), F.max("unit").alias("unit"), F.max("source").alias("source"),
        F.round(F.avg("factor_value"), 4).alias("avg_value"),
        F.round(F.min("factor_value"), 4).alias("min_value"), F.round(F.max("factor_value"), 4).alias("max_value"),
    )


def pivot_factors(df: DataFrame, names: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Long factor rows to one column per requested factor, mean of repeated dates."""
    wide = df.groupBy("factor_date").pivot("factor_name", list(names)).agg(F.avg("factor_value"))
    return wide.toDF("factor_date", *(columns or names))


def duration_rollup(df: DataFrame, slow: float = 5.0, very_slow: float = 30.0) -> DataFrame:
    """Latency figures per operation; the slow count leaves the very slow ones out."""
    d = F.col("duration_seconds")
    is_very, is_slow = d > very_slow, (d > slow) & (d <= very_slow)
    return df.groupBy("operation").agg(
        F.count("*").alias("total_executions"), F.round(F.avg(d), 2).alias("average_duration"),
        F.round(F.min(d), 2).alias("min_duration"), F.round(F.max(d), 2).alias("max_duration"),
        F.count_if(is_slow).alias("slow_operations"), F.count_if(is_very).alias("very_slow_operations"),
        F.round(F.count_if(is_slow | is_very) / F.count("*") * 100, 2).alias("slow_percentage"),
    )


def with_group_totals(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Attach group aggregates to each row.

    Map-side combined totals joined back, rather than a window: a group holding a large
    share of the rows is never gathered in one task, and AQE splits its side of the join.
    NULL keys match each other.
    """
    totals = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[a.alias(n) for n, a in aggs.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(totals, on).drop(*[f"_k_{k}" for k in keys])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark limits each group before the shuffle (window group limit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)

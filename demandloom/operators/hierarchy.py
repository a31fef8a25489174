"""Pushing totals down a hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.scalars import period_start
from demandloom.operators.totals import with_group_totals


def split_ratios(
    flat: DataFrame, source: Sequence[str], target: Sequence[str], *, date: str = "sale_date", interval: str | None = None,
    quantity: str = "quantity",
) -> DataFrame:
    """Share of each target member in its source group; per period when an interval is given.

    A group that sums to zero allocates zero.
    """
    cols = list(dict.fromkeys([*source, *target]))
    keys = list(source)
    if interval:
        flat = flat.withColumn("period", period_start(F.col(date), interval))
        cols, keys = [*cols, "period"], [*keys, "period"]
    fine = flat.groupBy(*cols).agg(F.sum(quantity).alias("target_total"))
    both = with_group_totals(fine, keys, {"source_total": F.sum("target_total")})
    return both.withColumn("allocation_factor", F.coalesce(F.try_divide("target_total", "source_total"), F.lit(0.0)))


def allocate(totals: DataFrame, ratios: DataFrame, keys: Sequence[str], quantity: str = "quantity", digits: int | None = None) -> DataFrame:
    """Group totals times the ratios of their members, matched on the group (and period) columns."""
    skip = totals.where(F.col(quantity).isNotNull() & (F.col(quantity) != 0))
    out = skip.join(ratios.select(*[c for c in ratios.columns if c not in ("target_total", "source_total")]), list(keys))
    share = F.col(quantity) * F.col("allocation_factor")
    return out.withColumn(quantity, F.round(share, digits) if digits is not None else share).drop("allocation_factor")


def member_ratios(
    members: DataFrame, group: Sequence[str], member: str = "master_id", table: DataFrame | None = None,
    date: str = "plan_date", start: str | None = None, end: str | None = None, quantity: str = "quantity",
    clamp: bool = True,
) -> DataFrame:
    """Ratio of every member within its group.

    ``table`` is the member's own table or another key figure; without one the split is
    equal, as it is for groups whose table holds nothing in the window. Totals at or below
    zero count as zero when ``clamp`` is set.
    """
    base = members.select(*group, member).distinct()
    if table is None:
        weighted = base.withColumn("_w", F.lit(0.0))
    else:
        rows = table
        if start:
            rows = rows.where(F.col(date) >= F.lit(start).cast("date"))
        if end:
            rows = rows.where(F.col(date) <= F.lit(end).cast("date"))
        sums = rows.groupBy(member).agg(F.sum(quantity).alias("_s"))
        w = F.coalesce("_s", F.lit(0.0))
        weighted = base.join(sums, member, "left").withColumn("_w", F.greatest(w, F.lit(0.0)) if clamp else w).drop("_s")
    totalled = with_group_totals(weighted, group, {"_t": F.sum("_w"), "_n": F.count("*")})
    ratio = F.when(F.col("_t") > 0, F.try_divide("_w", "_t")).otherwise(1.0 / F.col("_n"))
    return totalled.select(*group, member, ratio.alias("ratio"))


def apply_ratios(ratios: DataFrame, periods: DataFrame, group: Sequence[str], member: str = "master_id", date: str = "plan_date", quantity: str = "quantity") -> DataFrame:
    """Rounded shares whose rounding drift goes to the member with the highest ratio.

    ``periods`` holds (group columns, date, quantity). Drift and its receiver come from a
    map-side combined aggregate, so a group of any size never meets in one task.
    """
    spread = ratios.join(periods.withColumnRenamed(quantity, "_total"), list(group))
    spread = spread.withColumn(quantity, F.round(F.col("ratio") * F.col("_total"), 4))
    fixed = with_group_totals(
        spread, [*group, date],
        {"_sum": F.sum(quantity), "_top": F.min_by(F.col(member), F.struct(-F.col("ratio"), F.col(member)))},
    )
    drift = F.round(F.col("_total") - F.col("_sum"), 4)
    receives = (F.col(member) == F.col("_top")) & (F.col("_total") != 0)
    fixed = fixed.withColumn(quantity, F.when(receives, F.round(F.col(quantity) + drift, 4)).otherwise(F.col(quantity)))
    return fixed.select(*group, member, date, "ratio", quantity)


def period_totals(table: DataFrame, members: DataFrame, group: Sequence[str], start: str, end: str, member: str = "master_id", date: str = "plan_date", quantity: str = "quantity") -> DataFrame:
    """Range mode: existing totals of each group per date."""
    rows = table.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    joined = rows.select(member, date, quantity).join(members.select(*group, member).distinct(), member)
    return joined.groupBy(*group, date).agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias(quantity))


def listed_periods(groups: DataFrame, group: Sequence[str], periods: Sequence[tuple[str, float]], date: str = "plan_date", quantity: str = "quantity") -> DataFrame:
    """List and single mode: the request's dates and quantities for each group."""
    entries = F.array(*[F.struct(F.lit(d).cast("date").alias(date), F.lit(float(q)).alias(quantity)) for d, q in periods])
    return groups.select(*group).distinct().withColumn("_p", F.explode(entries)).select(*group, "_p.*")


def tag_disaggregated(rows: DataFrame, target_columns: Sequence[str], **columns: Column) -> DataFrame:
    """Mark rows as disaggregated where the target table can hold the mark."""
    out = rows
    if "type" in target_columns:
        out = out.withColumn("type", F.lit("disaggregated"))
    for name, value in columns.items():
        if name in target_columns:
            out = out.withColumn(name, value)
    return out

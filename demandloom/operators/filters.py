"""Predicates, paging and facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.scalars import erp_moment

# Request keys that steer a job and are not dimension filters.
CONTROL_KEYS = {"aggregation_level", "interval", "selected_external_factors"}


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def dimension_filter(filters: Mapping[str, Any] | None) -> Column:
    """Scalar means equal, list means IN; control keys are skipped."""
    out = []
    for key, value in (filters or {}).items():
        if key in CONTROL_KEYS:
            continue
        out.append(F.col(key).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(key) == value)
    return all_of(out)


def date_range(col: str, start: date | str | None = None, end: date | str | None = None) -> Column:
    """Inclusive; an open bound is no bound."""
    out = []
    if start is not None:
        out.append(F.col(col) >= F.lit(str(start)).cast("date"))
    if end is not None:
        out.append(F.col(col) <= F.lit(str(end)).cast("date"))
    return all_of(out)


def same_group(group: Mapping[str, Any]) -> Column:
    """NULL-safe match of one group."""
    return all_of([F.col(k).eqNullSafe(F.lit(v)) for k, v in group.items()])


_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
}


def _is_iso(value: Any) -> bool:
    if not isinstance(value, str):
        return False
    try:
        date.fromisoformat(value[:10])
    except ValueError:
        return False
    return True


def condition(field: str, operator: str, value: Any, kind: str = "date") -> Column:
    """One ERP filter condition.

    A value that starts like an ISO date compares in time with a field of type ``kind``: a date,
    a timestamp, or ``string`` for raw ERP text, whose unreadable dates match nothing.
    """
    c = F.col(field)
    if operator == "in":
        values = value if isinstance(value, (list, tuple)) else [value]
        return any_of([c == v for v in values])
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator}")
    if _is_iso(value):
        stamp = value if "T" in value else f"{value}T00:00:00"
        moment = erp_moment(c) if kind == "string" else c.cast("timestamp_ntz")
        return _COMPARE[operator](moment, F.lit(stamp).cast("timestamp_ntz"))
    return _COMPARE[operator](c, value)


def _condition(kinds: Mapping[str, str], field: str, operator: str, value: Any) -> Column:
    return condition(field, operator, value, kinds.get(field, "date"))


def erp_filter(config: Mapping[str, Any], kinds: Mapping[str, str] | None = None) -> Column:
    """``{field: {op: value}}`` AND-ed, or ``{"and": [...], "or": [...]}`` groups AND-ed together.

    Group members are ``(field, op, value)``. Built from plain comparisons, so the scan
    receives whatever part of it can be pushed down. ``kinds`` gives the type of fields that
    are not dates already, as ``dict(df.dtypes)`` does.
    """
    kinds = kinds or {}
    condition = partial(_condition, kinds)
    if set(config) <= {"and", "or"}:
        parts = []
        if config.get("and"):
            parts.append(all_of([condition(*c) for c in config["and"]]))
        if config.get("or"):
            parts.append(any_of([condition(*c) for c in config["or"]]))
        return all_of(parts)
    return all_of([condition(f, op, v) for f, ops in config.items() for op, v in ops.items()])


def page(
    df: DataFrame, sort_by: str, tie_break: Sequence[str], number: int = 1, size: int = 50,
    descending: bool = False, allowed: Sequence[str] | None = None, fallback: str | None = None,
) -> DataFrame:
    """One page of a sorted listing. Sorting outside the allowed columns uses the fallback."""
    if allowed is not None and sort_by not in allowed:
        sort_by = fallback or allowed[0]
    key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
    return df.orderBy(key, *tie_break).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """Row count and page arithmetic of a listing."""
    pages = F.ceil(F.col("total_count") / size).cast("bigint")
    return df.agg(F.count("*").alias("total_count")).select(
        "total_count", pages.alias("total_pages"),
        (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"),
    )


def facet(df: DataFrame, field: str, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Values of one field with counts, under the other fields' filters."""
    others = {k: v for k, v in (filters or {}).items() if k != field and v}
    return (
        df.where(dimension_filter(others))
        .groupBy(F.col(field).alias("value"))
        .agg(F.count("*").alias("value_count"))
        .withColumn("display_value", F.coalesce(F.col("value").cast("string"), F.lit("NULL")))
    )


def facets(df: DataFrame, selections: Mapping[str, Any]) -> DataFrame:
    """Every field counted under all other selections, in one pass over the rows."""
    chosen = {k: v for k, v in selections.items() if v}
    passes = {k: F.coalesce(dimension_filter({k: v}), F.lit(False)) for k, v in chosen.items()}

    def entry(field: str) -> Column:
        ok = all_of([p for k, p in passes.items() if k != field])
        return F.when(ok, F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value")))

    entries = F.filter(F.array(*[entry(f) for f in selections]), lambda e: e.isNotNull())
    return (
        df.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.field").alias("field"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("value_count"))
    )


def paired_filters(df: DataFrame, arrays: Sequence[str], flags: bool = True) -> DataFrame:
    """Multi-value filters: equally long lists pair by position, unequal ones stay pooled.

    Output: one row per pair with each list column cut to its value, or the row unchanged.
    Single-value lists are constants and never decide the pairing.
    """
    sizes = [F.when(F.size(a) > 1, F.size(a)) for a in arrays]
    size_set = F.array_distinct(F.array_compact(F.array(*sizes)))
    n = F.when(F.size(size_set) == 1, F.element_at(size_set, 1)).otherwise(1)
    pooled = F.size(size_set) != 1
    keep = [c for c in df.columns if c not in arrays]
    parts = [
        F.when(pooled | (F.size(a) <= 1), F.col(a)).otherwise(F.array(F.get(F.col(a), F.col("position")))).alias(a)
        for a in arrays
    ]
    pos = df.withColumn("position", F.explode(F.sequence(F.lit(0), n - 1)))
    out = pos.select(*keep, "position", *parts, pooled.alias("pooled"))
    return out if flags else out.drop("pooled")

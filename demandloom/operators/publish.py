"""Versions, jobs, logs and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.session import cut_lineage

# Payload keys whose values never reach a log.
SENSITIVE_KEYS = [
    "password", "password_hash", "token", "access_token", "refresh_token", "authorization", "api_key", "secret",
    "client_secret",
]
REDACTED = "***redacted***"


def activate(versions: DataFrame, requests: DataFrame, kind: str, key: str) -> DataFrame:
    """Activate the requested versions; others of a requested type go inactive, other types stay."""
    asked = requests.select(F.col(kind).alias("_k"), F.col(key).alias("_v"))
    out = versions.join(asked, F.col(kind) == F.col("_k"), "left")
    state = F.when(F.col("_k").isNull(), F.col("is_active")).otherwise(F.col(key) == F.col("_v"))
    return out.withColumn("is_active", state).drop("_k", "_v")


def deletable(versions: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Versions no run refers to."""
    return versions.join(runs.select(key), key, "left_anti")


def request_algorithms(jobs: DataFrame, request: str = "request_data") -> DataFrame:
    """One row per job and algorithm id, from a single id or a list of objects in the request."""
    single = F.get_json_object(request, "$.algorithm_id").try_cast("int")
    many = F.from_json(F.get_json_object(request, "$.algorithms"), "array<struct<algorithm_id int>>")
    ids = F.array_compact(F.array_distinct(F.concat(F.array(single), F.coalesce(many["algorithm_id"], F.array().cast("array<int>")))))
    return jobs.withColumn("algorithm_id", F.explode_outer(ids))


def in_zone(c: Column, zone: str) -> Column:
    """UTC wall time to the wall time of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def job_history(
    jobs: DataFrame, algorithms: DataFrame, zone: str = "UTC", user: str | None = None,
    created_from: str | None = None, created_to: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Jobs newest first with the names of their algorithms and zone-local times."""
    rows = jobs
    if user is not None:
        rows = rows.where(F.col("created_by") == user)
    if created_from is not None:
        rows = rows.where(F.col("created_at") >= F.lit(created_from).cast("timestamp_ntz"))
    if created_to is not None:
        rows = rows.where(F.col("created_at") <= F.lit(created_to).cast("timestamp_ntz"))
    if limit is not None:
        rows = rows.orderBy(F.col("created_at").desc(), "job_id").limit(limit)
    named = request_algorithms(rows).join(algorithms, "algorithm_id", "left")
    return named.withColumn("created_local", in_zone(F.col("created_at"), zone))


def canonical_json(text: Column, depth: int = 4) -> Column:
    """JSON text with the keys of its objects sorted, down to ``depth`` levels."""
    if depth == 0:
        return text
    deeper = lambda v: F.coalesce(canonical_json(v, depth - 1), F.lit("null"))
    pairs = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), deeper(e["value"])))
    items = F.transform(F.from_json(text, "array<string>"), deeper)
    wrap = lambda a, xs, b: F.concat(F.lit(a), F.array_join(xs, ","), F.lit(b))
    return F.when(F.startswith(text, F.lit("{")), wrap("{", F.sort_array(pairs), "}")).when(F.startswith(text, F.lit("[")), wrap("[", items, "]")).otherwise(text)


def duplicate_running(new: DataFrame, running: DataFrame, request: str = "request_data") -> DataFrame:
    """New jobs whose filters, dates and algorithms equal those of a running one, in whatever order their keys stand."""
    parts = ["forecast_filters", "forecast_start", "forecast_end", "algorithms"]

    def key(df: DataFrame) -> Column:
        return F.sha2(F.to_json(F.array(*[F.coalesce(canonical_json(F.get_json_object(request, f"$.{p}")), F.lit("null")) for p in parts])), 256)

    known = running.select(key(running).alias("request_key")).distinct()
    return new.withColumn("request_key", key(new)).join(known, "request_key", "left_semi").drop("request_key")


def _redact_texts(texts: pd.Series) -> pd.Series:
    def walk(v):
        if isinstance(v, dict):
            return {k: REDACTED if k.lower() in SENSITIVE_KEYS else walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text)))
        except ValueError:
            return text

    return texts.map(one)


def redact(df: DataFrame, payload: str) -> DataFrame:
    """The rows with the values of sensitive keys in the JSON text replaced, at any depth.

    Plain values are replaced in the JVM. Only rows where a sensitive key holds an object or array, or
    that spell keys with unicode escapes, pass through Python: the two kinds of rows are filtered apart.
    """
    keys = "|".join(SENSITIVE_KEYS)
    scalar = rf'(?i)"({keys})"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9][-+0-9.eE]*|true|false|null)'
    hard = F.col(payload).rlike(rf'(?i)"({keys})"\s*:\s*[\[{{]') | F.col(payload).contains("\\u")
    hard = F.coalesce(hard, F.lit(False))
    nested = F.pandas_udf(_redact_texts, T.StringType())
    plain = df.where(~hard).withColumn(payload, F.regexp_replace(payload, scalar, f'"$1": "{REDACTED}"'))
    return plain.unionByName(df.where(hard).withColumn(payload, nested(F.col(payload))))


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in sort order without gathering the rows in one task.

    Range-partitioned rows get their position inside the partition; a small frame of
    partition sizes (one row per partition) turns positions into numbers. The checkpoint
    fixes the ranges, which a recomputation could otherwise draw differently.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    part, pos = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_o"))
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(
        name, F.col("_o") + pos + 1
    ).drop("_i", "_p", "_o")


def wide_dashboard(rows: DataFrame, dims: Sequence[str], series: str, date: str, months: Sequence[str]) -> DataFrame:
    """One row per dimension row and series, one column per month (``yyyy-MM``), first known unit."""
    month = F.date_format(date, "yyyy-MM")
    # The months' own range first: plain comparisons, which the scan can prune by.
    first, last = (F.lit(f"{m}-01").cast("date") for m in (min(months), max(months)))
    rows = rows.where((F.col(date) >= first) & (F.col(date) < F.add_months(last, 1)))
    return rows.where(month.isin(list(months))).groupBy(*dims, series).agg(
        F.coalesce(F.min("uom"), F.lit("")).alias("uom"),
        *[F.sum(F.when(month == m, F.col("quantity"))).alias(F"m_{m.replace('-', '_')}") for m in months],
    )

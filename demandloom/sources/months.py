"""Tables kept by month: a merge reads and writes only the months that its batch touches.

A version is one small file that names the folder of every month. A merge writes new folders for the
touched months and lets the new version name the old folders of all others, so its cost follows the
batch and not the table. The file is created once, by one writer: whoever comes second, or has merged
into a version that is no longer the last, gets ``Conflict`` and can merge again. Readers hold on to
the folders of their version, which no later one changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandloom.operators.upsert import upsert
from demandloom.session import cut_lineage
from demandloom.sources.tables import LEGAL, Conflict, _folder, _names, claim

MONTH, UNDATED = "month_", "undated"


def month_of(date: Column) -> Column:
    """Name of the month folder of a date."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def _files(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of all version files, those of lost writers included."""
    names = _names(spark, f"{root}/{name}/versions", files=True)
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, root: str, name: str, version: int) -> dict | None:
    """The version's file; None if its writer was lost before it was whole."""
    fs, where = _folder(spark, f"{root}/{name}/versions/{version:09d}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    except ValueError:
        return None
    finally:
        stream.close()


def _last(spark: SparkSession, root: str, name: str) -> tuple[int, dict | None]:
    """Number and content of the last whole version; 0 and None for a new table."""
    for version in reversed(_files(spark, root, name)):
        content = _read(spark, root, name, version)
        if content is not None:
            return version, content
    return 0, None


def _commit(spark: SparkSession, root: str, name: str, base: int, number: int, content: dict) -> int:
    if _last(spark, root, name)[0] != base:
        raise Conflict(f"{name} has a newer version than {base}")
    claim(spark, f"{root}/{name}/versions/{number:09d}.json", json.dumps(content).encode())
    return number


def _write(df: DataFrame, root: str, name: str, date: str) -> dict[str, str]:
    """Rows by month in a folder of their own; the months and where they lie.

    A month's rows go to one task, or to several where they are many: AQE splits what it rebalances.
    """
    spark, part = df.sparkSession, uuid.uuid4().hex
    rows = df.withColumn(MONTH, month_of(F.col(date))).hint("rebalance", MONTH)
    rows.write.partitionBy(MONTH).parquet(f"{root}/{name}/data/{part}")
    found = [n for n in _names(spark, f"{root}/{name}/data/{part}") if n.startswith(f"{MONTH}=")]
    return {n.split("=", 1)[1]: f"data/{part}/{n}" for n in found}


def _check(name: str, df: DataFrame, date: str) -> None:
    if not LEGAL.fullmatch(name):
        raise ValueError(f"illegal table name {name}")
    if date not in df.columns or MONTH in df.columns:
        raise ValueError(f"a table by month has a column {date} and none named {MONTH}")


def create(df: DataFrame, root: str, name: str, date: str) -> int:
    """First version of a new table; a table that exists is refused. An empty frame makes an empty table."""
    _check(name, df, date)
    spark = df.sparkSession
    used = _files(spark, root, name)
    if _last(spark, root, name)[0]:
        raise ValueError(f"table {name} exists")
    months = _write(df, root, name, date)
    return _commit(spark, root, name, 0, max(used, default=0) + 1, {"date": date, "schema": df.schema.jsonValue(), "months": months})


def merge(batch: DataFrame, root: str, name: str, keys: Sequence[str]) -> int:
    """Next version: rows of ``batch`` replace those with the same key, the others are added.

    ``batch`` has unique keys, and the table's date is one of them, so a row cannot change its month.
    Columns may be added, but none may change its type. NULL keys match nothing. The driver holds a name
    for each month, which the calendar bounds. An empty batch yields a version equal to the last.
    """
    spark = batch.sparkSession
    used = _files(spark, root, name)
    base, old = _last(spark, root, name)
    if old is None:
        raise ValueError(f"no such table: {name}")
    _check(name, batch, old["date"])
    if old["date"] not in keys:
        raise ValueError(f"the date {old['date']} must be one of the keys")
    schema = StructType.fromJson(old["schema"])
    have = dict(batch.dtypes)
    changed = [f.name for f in schema.fields if f.name in have and have[f.name] != f.dataType.simpleString()]
    if changed:
        raise ValueError(f"columns of another type {changed}")
    # Read twice, for its months and for the merge.
    batch = cut_lineage(batch)
    touched = {r[0] for r in batch.select(month_of(F.col(old["date"]))).distinct().collect()}
    merged = upsert(_rows(spark, root, name, schema, [p for m, p in old["months"].items() if m in touched]), batch, keys)
    months = {m: p for m, p in old["months"].items() if m not in touched} | (_write(merged, root, name, old["date"]) if touched else {})
    content = {"date": old["date"], "schema": merged.schema.jsonValue(), "months": months}
    return _commit(spark, root, name, base, max(used) + 1, content)


def _rows(spark: SparkSession, root: str, name: str, schema: StructType, folders: Iterable[str]) -> DataFrame:
    paths = [f"{root}/{name}/{p}" for p in sorted(folders)]
    nullable = StructType.fromJson({"type": "struct", "fields": [f | {"nullable": True} for f in schema.jsonValue()["fields"]]})
    return spark.read.schema(nullable).parquet(*paths) if paths else spark.createDataFrame([], nullable)


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Whole versions, oldest first."""
    return [v for v in _files(spark, root, name) if _read(spark, root, name, v) is not None]


def months(spark: SparkSession, root: str, name: str, version: int | None = None) -> dict[str, str]:
    """The months of a version, the last one by default, and the folder of each."""
    content = _read(spark, root, name, version) if version in _files(spark, root, name) else None
    if version is None:
        content = _last(spark, root, name)[1]
    if content is None:
        raise ValueError(f"no such table or version: {name}")
    return dict(sorted(content["months"].items()))


def read(spark: SparkSession, root: str, name: str, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of a version, the last one by default; with ``first`` or ``last`` only the folders of those months (yyyy-MM) are opened."""
    version = _last(spark, root, name)[0] if version is None else version
    held = months(spark, root, name, version)
    inside = [p for m, p in held.items() if (first is None or first <= m != UNDATED) and (last is None or m <= last)]
    return _rows(spark, root, name, StructType.fromJson(_read(spark, root, name, version)["schema"]), inside)

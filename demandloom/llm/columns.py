"""Column helpers the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.session import cut_lineage

GAP = "[ \\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words, which are runs of anything but ASCII white space. Null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII text takes the fast path."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def packed(docs: DataFrame, name: str = "row_") -> DataFrame:
    """All columns in one struct, so that computed names cannot clash with those of the input."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], extra: dict[str, Column], name: str = "row_") -> DataFrame:
    """The input's columns again, then ``extra``; an extra column replaces an input column of its name."""
    kept = [F.col(name).getField(c).alias(c) for c in columns if c not in extra]
    return df.select(*kept, *[v.alias(k) for k, v in extra.items()])


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys, null equal to null; the keys of ``a`` stay."""
    b = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
    return a.join(b, [a[k].eqNullSafe(b[f"{k}_b"]) for k in keys], how).drop(*[f"{k}_b" for k in keys])


def placed(docs: DataFrame) -> DataFrame:
    """All columns in ``row_`` and a number ``at`` for each row, given once and written with the rows.

    A scan may be split otherwise in a later job, so numbers that are given again can meet other rows.
    """
    return stored(packed(docs).withColumn("at", F.monotonically_increasing_id()))


def stored(df: DataFrame) -> DataFrame:
    """The frame written once, as a table in the shared folder of ``spark.checkpoint.dir``, and read from there.

    The tables of an application lie in one folder of its id, to be removed when the application is done.
    """
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return cut_lineage(df)
    path = f"{shared.rstrip('/')}/{df.sparkSession.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

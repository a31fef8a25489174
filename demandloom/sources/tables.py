"""Tables as folders of versions: a write makes a new version, readers see the last finished one.

A version is finished once its writer has committed it (``_SUCCESS``), so a reader never sees half a
table and a lost job leaves the old version in place. All paths go through Hadoop file systems.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from demandloom.sources.catalogue import Catalogue

LEGAL = re.compile(r"[a-z0-9_]{1,63}")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str, files: bool = False) -> list[str]:
    fs, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() != files) if fs.exists(where) else []


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Finished versions, oldest first."""
    out = []
    for v in _names(spark, f"{root}/{name}"):
        fs, mark = _folder(spark, f"{root}/{name}/{v}/_SUCCESS")
        if v.startswith("v") and v[1:].isdigit() and fs.exists(mark):
            out.append(int(v[1:]))
    return sorted(out)


class Conflict(RuntimeError):
    """Another writer came first."""


def claim(spark: SparkSession, path: str, content: bytes = b"") -> None:
    """Create a file that no one else has created; ``Conflict`` if it exists."""
    fs, where = _folder(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if fs.exists(where):
            raise Conflict(f"another writer has {path}") from error
        raise
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_table(df: DataFrame, root: str, name: str, catalogue: Catalogue | None = None) -> int:
    """Write the next version and return its number; of two writers with the same number the second gets ``Conflict``.

    With a catalogue the columns it declares must have its types.
    """
    if not LEGAL.fullmatch(name):
        raise ValueError(f"illegal table name {name}")
    if catalogue:
        have = dict(df.dtypes)
        wrong = [f.name for f in catalogue.schema().fields if have.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"columns missing or of another type {wrong}")
    spark = df.sparkSession
    # Folders and claims of lost writers keep their numbers.
    taken = _names(spark, f"{root}/{name}") + [c.removesuffix(".claim") for c in _names(spark, f"{root}/{name}", files=True)]
    used = [int(v[1:]) for v in taken if v[1:].isdigit()]
    version = max(used, default=0) + 1
    claim(spark, f"{root}/{name}/v{version:09d}.claim")
    df.write.parquet(f"{root}/{name}/v{version:09d}")
    return version


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The last finished version, or the given one."""
    have = versions(spark, root, name)
    if not have or (version is not None and version not in have):
        raise ValueError(f"no such table or version: {name}")
    return spark.read.parquet(f"{root}/{name}/v{have[-1] if version is None else version:09d}")


def list_tables(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _names(spark, root) if LEGAL.fullmatch(n) and versions(spark, root, n)]


def drop_table(spark: SparkSession, root: str, name: str) -> bool:
    fs, where = _folder(spark, f"{root}/{name}")
    return bool(LEGAL.fullmatch(name)) and fs.delete(where, True)

"""Merging batches into tables. A merge reads the old table and yields the new one;
the caller writes it to a new path and swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.scalars import natural_key


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key. An aggregate, so repeats of a hot key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key. ``new`` has unique keys.

    One outer join reads either side once. A column that only the old rows have is NULL in new ones.
    """
    columns = [*existing.columns, *[c for c in new.columns if c not in existing.columns]]
    old = existing.select(F.struct(*existing.columns).alias("_old"))
    fresh = new.select(F.struct(*new.columns).alias("_new"))
    same = [F.col(f"_old.{k}") == F.col(f"_new.{k}") for k in keys]

    def pick(c: str) -> Column:
        newer = F.col(f"_new.{c}") if c in new.columns else F.lit(None)
        older = F.col(f"_old.{c}") if c in existing.columns else F.lit(None)
        return F.when(F.col("_new").isNotNull(), newer).otherwise(older).alias(c)

    return old.join(fresh, same, "full").select(*[pick(c) for c in columns])


def upsert_flags(existing: DataFrame, new: DataFrame, keys: Sequence[str], key_values: Sequence[str] = ()) -> DataFrame:
    """The new rows with ``action`` inserted or updated."""
    seen = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_e_{k}"))
    hit = F.col(f"_e_{keys[0]}").isNotNull()
    return new.join(seen, cond, "left").withColumn("action", F.when(hit, "updated").otherwise("inserted")).drop(
        *[f"_e_{k}" for k in keys]
    )


def upsert_target_only(existing: DataFrame, new: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """On conflict only the target changes; other columns keep their old values."""
    e, n = existing.alias("e"), new.alias("n")
    cols = [c for c in existing.columns if c not in keys]

    def pick(c: str) -> Column:
        if c == target:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"e.{c}")).alias(c)
        present = F.col(f"e.{keys[0]}").isNotNull()
        return F.when(present, F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"e.{k}") == F.col(f"n.{k}"))
    joined = e.join(n, cond, "full")
    return joined.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[pick(c) for c in cols])


def find_or_create(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Dimension after the batch: old rows, plus the first row of every unseen key.

    Keys compare NULL-safely. Without keys every incoming row is new. New ids are hashes of
    the key, so a repeated job makes the same ids. One outer join reads either side once.
    """
    columns = existing.columns
    if not keys:
        data = [c for c in incoming.columns if c not in order]
        fresh = incoming.withColumn(id_col, natural_key([*data, *order])).withColumn("is_new", F.lit(True))
        return existing.withColumn("is_new", F.lit(False)).unionByName(fresh.select(*columns, "is_new"))
    firsts = first_per_key(incoming, keys, order).withColumn(id_col, natural_key(keys)).select(*columns)
    return _with_unseen(existing, firsts, keys).select(*columns, "is_new")


def _with_unseen(existing: DataFrame, firsts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and those of ``firsts`` whose key none of them has, marked ``is_new``."""
    old = existing.select(F.struct(*existing.columns).alias("_old"))
    fresh = firsts.select(F.struct(*firsts.columns).alias("_new"))
    same = [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys]
    # A row of NULLs on the other side would look like an equal key: the flags tell them apart.
    met = old.withColumn("_has_old", F.lit(True)).join(fresh, same, "full")
    return met.select(F.coalesce("_old", "_new").alias("_row"), F.col("_has_old").isNull().alias("is_new")).select("_row.*", "is_new")


def insert_absent(existing: DataFrame, incoming: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    """Whole-row insert-if-absent. Empty texts count as NULL; unknown fields are refused."""
    unknown = [c for c in incoming.columns if c not in fields]
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    blank = incoming.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in fields]).distinct()
    fresh = blank.withColumn(id_col, natural_key(fields)).select(*existing.columns)
    return _with_unseen(existing, fresh, fields).select(*existing.columns)


def soft_delete(df: DataFrame, hit: Column, stamp: Column, column: str = "deleted_at") -> DataFrame:
    """Mark matching live rows; rows deleted before keep their stamp."""
    return df.withColumn(column, F.when(hit & F.col(column).isNull(), stamp).otherwise(F.col(column)))


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Status of every key of two copies: missing on the right, extra on the right, mismatched or same."""
    l, r = left.select(*keys, F.struct(*values).alias("_l")), right.select(*keys, F.struct(*values).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra")
        .when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("mismatched")
    )
    return l.join(r, list(keys), "full").select(*keys, status.alias("status"), "_l", "_r")


def repair(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The right copy with missing and mismatched rows taken from the left; extra rows stay."""
    fixed = table_diff(left, right, keys, values)
    pick = F.coalesce(F.col("_l"), F.col("_r")).alias("_v")
    return fixed.select(*keys, pick, F.col("status").isin("missing", "mismatched").alias("repaired")).select(
        *keys, "_v.*", "repaired"
    )


def latest_attributes(facts: DataFrame, key: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest attribute values per key."""
    picked = facts.groupBy(key).agg(F.max_by(F.struct(*attributes), F.struct(*order)).alias("_a"))
    return picked.select(key, "_a.*")


def lowest_text(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Lowest text of each key. Repeats go by a hash aggregate first: the minimum of a text needs a sort."""
    return rows.select(*keys, text).distinct().groupBy(*keys).agg(F.min(text).alias(text))


def resolve_master(entities: DataFrame, dims: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lowest master_id that matches each entity; NULL where none does."""
    first = lowest_text(dims, cols, "master_id")
    return entities.join(first, list(cols), "left")

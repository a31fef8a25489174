"""Corpus-wide line deduplication that exchanges line hashes and returns keep bitmaps, not text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.columns import ascii_lower, join_null_safe, let, packed, unpacked
from demandloom.session import cut_lineage

MIN_DOCS, MIN_CHARS, SALTS = 10, 1, 32
BLANK = " \t\n\x0b\f\r"
DOC = ["doc", "mark"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """A row per line long enough to count: 128-bit hash of its key, document, position.

    A document is (id, hash of its text), so rows repeated whole are one document.
    """
    hashes = F.transform(lines(docs[text]), lambda x: let(line_key(x), lambda k: F.when(
        F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(0), k).alias("h2")))))
    per_doc = docs.select(docs[doc_id].alias("doc"), F.xxhash64(docs[text]).alias("mark"), hashes.alias("lines"))
    per_line = per_doc.select(*DOC, F.posexplode("lines").alias("pos", "x")).where("x IS NOT NULL")
    salt = F.pmod(F.xxhash64(*DOC), F.lit(SALTS)).cast("int")
    return per_line.select("x.h1", "x.h2", salt.alias("salt"), *DOC, "pos")


def drops(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """Rows (document, position) to drop.

    Line hashes are range-partitioned with a salt, so one hash may spread over ``SALTS`` ranges, and
    sorted by document and position. The stream over a sorted range marks a hash's first occurrence in
    each document and counts them; the counts of the ranges are added up by hash, one row per range and
    hash. ``keep``: "none" drops all lines of a key found in ``min_docs`` documents, "first" keeps the
    first occurrence in the corpus.
    """
    hash_, ranged = ["h1", "h2"], ["h1", "h2", "salt"]
    rows = cut_lineage(occurrences(docs, text, doc_id, min_chars))
    stream = Window.partitionBy(*ranged).orderBy(*DOC, "pos")
    new = ~F.coalesce(F.lag(F.struct(*DOC)).over(stream).eqNullSafe(F.struct(*DOC)), F.lit(False))
    marked = rows.repartitionByRange(*ranged).withColumn("new", new)
    seen = marked.groupBy(*hash_).agg(F.sum(F.col("new").cast("int")).alias("n_docs"), F.min(F.struct(*DOC, "pos")).alias("first"))
    common = seen.where(F.col("n_docs") >= min_docs)
    found = join_null_safe(rows, common, hash_)
    if keep == "first":
        found = found.where(~F.struct(*DOC, "pos").eqNullSafe(F.col("first")))
    return found.select(*DOC, "pos").distinct()


def bitmaps(dropped: DataFrame) -> DataFrame:
    """Keep bitmaps: per document its 64-line words that lose a line, as (word, bits kept); all other words are full."""
    bit = F.expr("shiftleft(1L, pos % 64)")
    part = dropped.groupBy(*DOC, F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("kept"))
    return part.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("word", "kept"))).alias("keep"))


def dropped_places(keep: Column) -> Column:
    places = F.transform(keep, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w["kept"], b) == 0), lambda b: w["word"] * 64 + b))
    return F.flatten(places)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Every document with ``n_lines``, ``n_dropped``, its ``keep`` bitmap (null: all stay) and ``kept_text``.

    A null or empty text is one empty line, which never counts as a key; a text whose lines all go
    becomes empty; rows repeated whole are one document and get the same result each; an empty table
    gives no rows; an input column with a computed name is replaced.
    """
    own = docs.columns
    keep = bitmaps(drops(docs, text, doc_id, **options))
    rows = packed(docs).withColumns({"doc": F.col("row_").getField(doc_id), "mark": F.xxhash64(F.col("row_").getField(text))})
    df = join_null_safe(rows, keep, DOC, "left").select("row_", "keep")
    body = F.coalesce(F.col("row_").getField(text), F.lit(""))
    left = let(lines(body), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped_places(F.col("keep"))), lambda i: x[i]), "\n"))
    gone = F.aggregate(F.col("keep"), F.lit(0).cast("long"), lambda a, w: a + 64 - F.bit_count(w["kept"]))
    return unpacked(df, own, {
        "n_lines": F.size(lines(body)).cast("long"), "n_dropped": F.coalesce(gone, F.lit(0).cast("long")), "keep": F.col("keep"),
        "kept_text": F.when(F.col("keep").isNull(), body).otherwise(left),
    })

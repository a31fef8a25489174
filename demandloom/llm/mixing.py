"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.columns import join_null_safe, packed, unpacked, words
from demandloom.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
TIES, FALL, SEED = 1024, 1 << 40, "mix"


def size_in_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _level(sources: DataFrame, total: float) -> float | None:
    """Words per weight so that the targets, each at most its cap, add up to ``total``; None if all stop at caps.

    Each round is one aggregate over the sources; a source over its cap stops there and the rest is
    shared anew, until no further one stops. The driver sees three sums a round.
    """
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        caps, weights, n = sources.agg(
            F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))
        ).first()
        if not weights:
            return None
        if n == stopped:
            return level
        level, stopped = (total - (caps or 0.0)) / weights, n


def targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Source, its size and its target. Weights repeat over the sources by code point, null last.

    One row per source is numbered: by ranges of sources, not in one task.
    """
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ranged = sizes.repartitionByRange(F.isnull("source"), "source").sortWithinPartitions(F.isnull("source"), "source")
    placed = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, pos = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition: bounded, and the broadcast as well.
    numbered = placed.withColumn("part", part).join(F.broadcast(parts.select("part", before.alias("start"))), "part")
    each = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.select(
        "source", "source_size", F.get(each, ((F.col("start") + pos) % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"),
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level = _level(weighed, share * total)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's one random offset in [0, 1), a multiple of 2^-20, drawn from its name."""
    name = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    Expected copies are target / source size for each document of a source. Within their source
    documents are ordered by size, half of them rising and half falling, so the running sum of expected
    copies samples all lengths evenly and a source's words miss the target by a part of one document; a
    document gets a copy for each integer boundary its part of the sum crosses. Positions come from
    counts per (source, size) and per tie bucket inside them, so no source or size is gathered in one
    task and nothing depends on how rows are partitioned. Only whole documents are taken: a source of a
    few documents can miss by one of them.

    Ids may be numbers, texts or whatever else sorts; ids that are no whole numbers go to their tie bucket
    by hash. Null text has size 0 and takes nothing; null is a source of its own; documents equal in source,
    size and id are interchangeable; an empty table gives no rows; an input column with a computed
    name is replaced. ``size`` replaces the word count of the text.
    """
    own = docs.columns
    size = size_in_words(docs[text]) if size is None else size
    whole = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    number = docs[doc_id] if whole else F.when(docs[doc_id].isNotNull(), F.xxhash64(docs[doc_id]))
    rows = docs.select(
        F.struct(*[docs[c] for c in own]).alias("row_"), docs[source].alias("source"), size.alias("size"), docs[doc_id].alias("id"),
        F.pmod(F.coalesce(number, F.lit(0)), F.lit(TIES)).cast("int").alias("tie"),
    )
    # Up through the sizes and down again: what the rise takes too little, the fall takes too much.
    rows = rows.withColumn("run", F.when(F.col("tie") % 2 == 0, F.col("size")).otherwise(F.lit(FALL) - F.col("size")))
    key = ["source", "run", "tie"]
    counts = cut_lineage(rows.groupBy(*key, "size").agg(F.count("*").alias("n")))
    plan = targets(counts, weights, share, most)
    running = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("source", "run").agg(F.sum("n").alias("all"))
    runs = runs.withColumn("first", F.coalesce(F.sum("all").over(running("source").orderBy("run")), F.lit(0)))
    ties = counts.withColumn("next", F.coalesce(F.sum("n").over(running("source", "run").orderBy("tie")), F.lit(0)))
    starts = join_null_safe(join_null_safe(ties, runs, ["source", "run"]), plan, ["source"])
    starts = starts.select(*key, (F.col("first") + F.col("next")).alias("start"), "source_size", "target")
    # A struct of a null equals itself, so window and join ask for the same keys and whole rows are exchanged once.
    near = [F.struct("source").alias("of"), "run", "tie"]
    ranked = rows.select("*", near[0]).withColumn("rank", F.row_number().over(Window.partitionBy("of", "run", "tie").orderBy("id")))
    df = ranked.join(starts.select(*near, "start", "source_size", "target"), ["of", "run", "tie"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("start") + F.col("rank")
    crossed = F.floor(at * rate + F.col("u")) - F.floor((at - 1) * rate + F.col("u"))
    df = df.withColumn("u", offset(F.col("source"), seed)).withColumn("copies", F.least(crossed, F.ceil(F.lit(most))).cast("int"))
    return unpacked(df, own, {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"),
        "taken": F.col("copies") * F.col("size"),
    })


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the input's columns.

    Columns besides ``text``, ``source`` and ``doc_id`` may have any name, those that ``mix`` computes
    included, and stay as they are. Empty and null texts are never taken; repeated rows are taken each for
    itself; a text's length matters only as its number of words; an empty table gives no rows.
    """
    own = docs.columns
    df = mix(packed(docs).select("row_", *[F.col("row_").getField(c).alias(c) for c in ("text", "source", "doc_id")]), **options)
    df = df.where("copies > 0").select("row_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(df, own, {})

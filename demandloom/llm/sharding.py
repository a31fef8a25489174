"""Sharding by histogram sort: exact splitters from counted probes, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.columns import packed, unpacked
from demandloom.session import cut_lineage

ROW_OVERHEAD = 16
SHARDS, PROBES, PIECE_BYTES = 40, 2048, 64 << 20
LOW, HIGH = 0, (1 << 62) - 1


@dataclass
class Search:
    """One splitter being looked for: the key that holds byte ``goal`` lies in [low, high]."""

    goal: int
    below: int = 0
    on: str = "h"
    low: int = LOW
    high: int = HIGH
    h: int | None = None
    done: tuple[int, int] | None = None


def keys(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Sort key of a document: text hash, then id hash. Copies lie together, yet any group can be cut."""
    half = lambda c: F.shiftrightunsigned(c, 2)
    return half(F.xxhash64(text)), half(F.xxhash64(F.lit("id"), doc_id))


def splitters(narrow: DataFrame, shards: int, probes: int = PROBES, tolerance: float = 0.0) -> list[tuple[int, int]]:
    """Keys after which shards 1, 2, ... begin: row by row the shard is floor(shards * bytes before / all bytes).

    Each round counts the exact bytes between evenly spaced probes inside the intervals still open,
    in one aggregate; the driver gets at most ``shards * probes`` sums. An interval closes at a single
    key, or once it holds no more than ``tolerance`` of a shard's bytes.
    """
    total = narrow.agg(F.sum("size")).first()[0] or 0
    open_ = [Search(goal=-(-j * total // shards)) for j in range(1, shards)] if total else []
    found = list(open_)
    while open_:
        spans = sorted({(s.on, s.low, s.high, s.h) for s in open_}, key=str)
        cells = _count(narrow, spans, probes)
        for s in open_:
            below = s.below
            for low, high, size, d_low, d_high in cells[(s.on, s.low, s.high, s.h)]:
                if below + size >= s.goal:
                    break
                below += size
            s.below = below
            if s.on == "h" and size <= tolerance * total / shards:
                s.done = (high, HIGH)
            elif s.on == "d" and (low == high or size <= tolerance * total / shards):
                s.done = (s.h, high)
            elif s.on == "h" and low == high:
                s.on, s.h, s.low, s.high = "d", low, d_low, d_high
            else:
                s.low, s.high = low, high
        open_ = [s for s in open_ if s.done is None]
    return [s.done for s in found]


def _count(narrow: DataFrame, spans: list[tuple], probes: int) -> dict[tuple, list[tuple]]:
    """Per span its cells that hold rows, in order: least and greatest key, bytes, least and greatest id hash."""
    inside, cell = [], []
    for on, low, high, h in spans:
        step = (high - low) // probes + 1
        fits = F.col(on).between(low, high) & ((F.col("h") == h) if on == "d" else F.lit(True))
        inside.append(F.when(fits, F.struct(F.lit(len(inside)).alias("span"), F.expr(f"int(({on} - {low}) div {step})").alias("cell"), F.col(on).alias("key"))))
        cell.append([])
    hits = narrow.select("size", "d", F.explode(F.array_compact(F.array(*inside))).alias("x"))
    sums = hits.groupBy("x.span", "x.cell").agg(F.min("x.key"), F.max("x.key"), F.sum("size"), F.min("d"), F.max("d"))
    for span, c, *rest in sums.collect():
        cell[span].append((c, *rest))
    return {s: [x[1:] for x in sorted(cell[i])] for i, s in enumerate(spans)}


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts lie before the row's key."""
    h, d, out = F.col("h"), F.col("d"), F.lit(0)
    for a, b in cuts:
        out = out + F.when((h > a) | ((h == a) & (d > b)), 1).otherwise(0)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.0, piece_bytes: int = PIECE_BYTES, size: Column | None = None, key: tuple[Column, Column] | None = None) -> DataFrame:
    """Every document with ``shard`` and a ``slot`` without gaps in it; shards hold nearly equal bytes.

    A document's size is its UTF-8 bytes plus ``ROW_OVERHEAD``. Rows are exchanged once, to pieces of
    a shard of about ``piece_bytes``, and slots continue from piece to piece, so a task's work does not
    grow with a shard. A null text has no bytes; rows equal in id and text share a key and stay in one
    shard; an empty table gives no rows; an input column named shard or slot is replaced. ``size`` and
    ``key`` take the place of what is computed from the text, for a caller that has them at hand.
    """
    own = docs.columns
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + ROW_OVERHEAD if size is None else size
    h, d = keys(docs[text], docs[doc_id]) if key is None else key
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row_"), size.alias("size"), h.alias("h"), d.alias("d"))
    narrow = cut_lineage(rows.select("size", "h", "d"))
    cuts = splitters(narrow, shards, tolerance=tolerance)
    total = narrow.agg(F.sum("size")).first()[0] or 0
    pieces = 8 + total // (shards * piece_bytes)
    place = [shard_of(cuts).alias("shard"), F.pmod(F.col("d"), F.lit(pieces)).alias("piece")]
    counts = narrow.select(*place).groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("h", "d")
    df = rows.select("*", *place).withColumn("rank", F.row_number().over(within)).join(starts, ["shard", "piece"])
    return unpacked(df, own, {"shard": F.col("shard"), "slot": (F.col("start") + F.col("rank") - 1).cast("long")})

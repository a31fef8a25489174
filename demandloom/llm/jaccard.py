"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, then exact intersection.

Two sets that reach the threshold share a shingle within the first few of each, in any order that all
sets follow (the prefix). A tile holds the classes of one shared prefix shingle and one band of set
sizes; pairs inside a tile pass a size and a place bound, then the bitmap bound, and what is left is
intersected. Equal sets are one class from the start. Groups need no link that found ones imply: for
them only pairs between different components are looked for; ``jaccard_links`` looks for every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.columns import let, placed, stored, unpacked
from demandloom.llm.shingles import Shingler, bitmap, pieces
from demandloom.session import cut_lineage

WORDS, PERCENT = 4, 85
SAMPLE, SEEN, COMMON = 32, 3, 1 << 18
FILTER_BITS = 1 << 24
HOT, BLOCK, WIDE_BITS = 256, 1024, 12
FLUSH, REMEMBERED = 1 << 18, 1 << 14
SALTS = 64


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many leading shingles a set must offer to any partner, and to a partner of its size or larger."""
    need, least = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    return n - need + 1, n - least + 1


def among(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted array."""
    if not len(often):
        return np.zeros(len(hashes), bool)
    return often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes


def prefix(hashes: np.ndarray, percent: int, often: np.ndarray) -> np.ndarray:
    """The set's first shingles in the order all sets follow: by hash, the common ones last."""
    late = among(hashes, often)
    return np.concatenate([hashes[~late], hashes[late]])[: prefix_sizes(len(hashes), percent)[0]]


def _class(hashes: np.ndarray) -> int:
    """64-bit name of a set; sets of one name are taken as equal."""
    sums = int(hashes.sum()) * 0xD6E8FEB86659FD93 % 2**64
    return (int(np.bitwise_xor.reduce(hashes)) ^ sums) - 2**63


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents hold, estimated on a hash sample; at most ``COMMON``.

    They go last in the order of shingles, which keeps tiles small. Any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, found, held = Shingler(words), [], 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["shingle", "n"])

        for s in (s for b in batches for part in pieces(b, 0) for s in shingler.sets(part.column(0))):
            found.append(s)
            held += len(s)
            if held > FLUSH:
                yield counted()
                found.clear()
                held = 0
        yield counted()

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(count, "shingle bigint, n bigint")
    often = some.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    rows = often.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Row place, id, class, set size and bitmap of every document; an empty set has no class."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in (part for batch in batches for part in pieces(batch, 2)):
            sets = list(shingler.sets(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["at", "doc_id", "cls", "n", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("at", "doc_id", "text").mapInArrow(sign, f"at bigint, doc_id {kind}, cls bigint, n bigint, bits array<bigint>"))


def shared_prefixes(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (token, class, size, place) of the prefix shingles that two classes or more share.

    Rows of common shingles are spread over ``SALTS`` groups of classes (``salt``, -1 for the others),
    so that no shingle gathers its rows in one task; their totals are at most ``COMMON`` rows.
    """
    last = docs.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often, done = Shingler(words), last.value, set()
        for b in (part for batch in batches for part in pieces(batch, 0)):
            out = []
            if len(done) > REMEMBERED:  # only spares work: what is given out twice is one row after the exchange
                done.clear()
            for s in shingler.sets(b.column(0)):
                n = len(s)
                name = _class(s) if n else None
                if not n or name in done:
                    continue
                done.add(name)
                p, q = prefix_sizes(n, percent)
                own = prefix(s, percent, often)
                salt = np.where(among(own, often), (name >> 32) % SALTS, -1)
                out.append((own.view(np.int64), np.full(p, name), np.full(p, n), np.arange(p), np.arange(p) < q, salt))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "cls", "n", "pos", "lead", "salt"])

    rows = docs.select("text").mapInArrow(prefixes, "token bigint, cls bigint, n bigint, pos bigint, lead boolean, salt bigint")
    rows = rows.select("token", "cls", *[F.col(c).cast("int").alias(c) for c in ("n", "pos", "salt")], "lead").repartition("token", "salt").distinct()
    by = Window.partitionBy("token", "salt")
    met = rows.withColumns({"low": F.min("cls").over(by), "high": F.max("cls").over(by), "led": F.max("lead").over(by)})
    met = stored(met.where("salt >= 0 OR (low < high AND led)"))
    often = met.where("salt >= 0")
    shared = often.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("led").alias("led")).where("low < high AND led")
    hits = met.where("salt < 0").unionByName(often.join(F.broadcast(shared.select("token")), "token", "left_semi"))
    return hits.select("token", "cls", "n", "pos", "lead", "salt")


def over_tokens(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """The rows with aggregates of their token; those of common tokens are a table in every task."""
    by = Window.partitionBy("token")
    rare, often = rows.where("salt < 0"), rows.where("salt >= 0")
    totals = often.groupBy("token").agg(*[m.alias(k) for k, m in measures.items()])
    return rare.withColumns({k: m.over(by) for k, m in measures.items()}).unionByName(often.join(F.broadcast(totals), "token"))


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def overlap_bound(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave room: a bit only one set has is a shingle the other lacks."""
    side = lambda x: signs.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)

    def most(x: Column, y: Column) -> Column:
        return F.least(F.col("n_a") - only(x, y), F.col("n_b") - only(y, x))

    length = F.least(F.size("bits_a"), F.size("bits_b"))
    bound = let(folded(F.col("bits_a"), length), lambda x: let(folded(F.col("bits_b"), length), lambda y: most(x, y)))
    return both.where(enough(bound, percent)).select("a", "b", "n_a", "n_b")


def folded(bits: Column, length: Column) -> Column:
    """The map as it would be with ``length`` words."""
    part = lambda j: F.slice(bits, j * length + 1, length)
    fold = F.aggregate(F.sequence(F.lit(1), (F.size(bits) / length).cast("int") - 1), part(F.lit(0)), lambda s, j: F.zip_with(s, part(j.cast("int")), lambda p, q: p.bitwiseOR(q)))
    return F.when(F.size(bits) == length, bits).otherwise(fold)


def enough(common: Column, percent: int) -> Column:
    return F.lit(100) * common >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - common)


def passed_by(wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, object]:
    """Documents with the place of their bit, and the broadcast filter of the wanted rows' bits.

    The filter has a fixed size; a larger share of it is set where more rows are wanted.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    filled = wanted.select(place(F.col("at")).alias("pos")).groupBy(F.expr("int(pos div 64)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pos % 64))")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in filled:
        table[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return docs.select("at", place(F.col("at")).alias("pos"), "text"), docs.sparkSession.sparkContext.broadcast(table)


def passing(batch: pa.RecordBatch, bits: np.ndarray, step: int = 256) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(at, text) of the rows that the filter lets through, a few at a time."""
    pos = batch.column(1).to_numpy()
    hit = pa.array((bits[pos // 64] >> (pos % 64).astype(np.uint64)) & np.uint64(1) == 1)
    ats, texts = batch.column(0).filter(hit), batch.column(2).filter(hit)
    for i in range(0, len(ats), step):
        yield ats[i : i + step], texts[i : i + step]


def verified(pairs: DataFrame, docs: DataFrame, signs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact overlap reaches the threshold.

    Sets are built again, for documents of the named classes alone: a bit filter of fixed size over
    their places lets them through, and whatever else passes is dropped by the join on the place.
    """
    pairs = stored(pairs)
    classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = stored(classes.join(signs.groupBy("cls").agg(F.min("at").alias("at")), "cls"))
    rows, asked = passed_by(wanted, docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for ats, texts in passing(b, asked.value):
                yield pa.RecordBatch.from_arrays([ats, pa.array([s.view(np.int64) for s in shingler.sets(texts)], pa.list_(pa.int64()))], ["at", "items"])

    sets = stored(rows.mapInArrow(build, "at bigint, items array<bigint>").join(wanted, "at").select("cls", "items"))
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("items").alias(f"items_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(enough(F.size(F.array_intersect("items_a", "items_b")), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(class, root) for every class in a link: the smallest class it can reach.

    Each round every class takes the smallest root among its neighbours' and then the root's own root;
    the rounds end when nothing changes. Each round's table is cut off by a checkpoint.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = cut_lineage(edges.groupBy(F.col("a").alias("cls")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = edges.join(roots, edges.b == roots.cls).groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        step = roots.join(near, "cls").select("cls", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        jump = roots.select(F.col("cls").alias("new"), F.col("root").alias("further"))
        step = cut_lineage(step.join(jump, "new").select("cls", "old", F.least("new", "further").alias("root")))
        changed = step.where("root < old").limit(1).count()
        roots = step.select("cls", "root")
        if not changed:
            return roots


def _star_pairs(hits: DataFrame, percent: int) -> DataFrame:
    """Each class with the least and the greatest class of each of its tiles' tokens."""
    ends = over_tokens(hits, {"low": F.min(F.struct("cls", "n")), "high": F.max(F.struct("cls", "n"))})
    ends = ends.select("cls", "n", F.explode(F.array("low", "high")).alias("x")).where(F.col("cls") != F.col("x.cls"))
    ends = ends.where(sizes_fit(F.col("n"), F.col("x.n"), percent))
    return ends.select(F.least("cls", "x.cls").alias("a"), F.greatest("cls", "x.cls").alias("b")).distinct()


def _between(hits: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of the tokens that classes of different components share, with ``root`` and the tile's size ``met``.

    Without ``roots`` every class is a component of its own.
    """
    named = hits.withColumn("root", F.col("cls")) if roots is None else stored(hits.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    named = over_tokens(named, {"low": F.min("root"), "high": F.max("root"), "met": F.count("*")})
    return stored(named.where("low < high").drop("low", "high", "salt"))


def _tile_pairs(named: DataFrame, percent: int) -> DataFrame:
    """Pairs between different components that meet in a small tile and pass the bounds on size and place."""
    named = named.where(F.col("met") <= HOT).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100))).cast("int"))
    # The smaller set is at home in its band; the larger one calls there from the same band or the next.
    # One band more on each side covers rounding at a band's edge.
    home = named.where("lead").select("token", F.col("band").alias("tile"), F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"), F.col("root").alias("r_a"))
    call = named.select("token", F.explode(F.array(*[F.col("band") - i for i in (-1, 0, 1, 2)])).alias("tile"), F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"), F.col("root").alias("r_b"))
    most = F.least("p_a", "p_b") + 1 + F.least(F.col("n_a") - F.col("p_a") - 1, F.col("n_b") - F.col("p_b") - 1)
    fits = ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") != F.col("b")))) & (F.col("r_a") != F.col("r_b"))
    met = home.join(call, ["token", "tile"]).where(fits & sizes_fit(F.col("n_a"), F.col("n_b"), percent) & enough(most, percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hot_pairs(named: DataFrame, docs: DataFrame, signs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """Pairs between different components in tiles of more than ``HOT`` classes, already bound by bitmaps.

    A tile is cut into blocks of about ``BLOCK`` classes and each pair of blocks is a task's group, so no
    tile has to fit in a task. Blocks are compared as matrices of wide bitmaps; a pair is given out
    only where the tile's token is the first prefix shingle the two share, so once over all tiles.
    """
    hot = named.where(F.col("met") > HOT)
    wanted = stored(hot.select("cls").distinct().join(signs.groupBy("cls").agg(F.min("at").alias("at")), "cls"))
    rows, asked = passed_by(wanted, docs)
    last = docs.sparkSession.sparkContext.broadcast(common)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for ats, texts in passing(b, asked.value):
                sets = list(shingler.sets(texts))
                heads = [prefix(s, percent, last.value).view(np.int64) for s in sets]
                wide = [bitmap(s, WIDE_BITS) for s in sets]
                yield pa.RecordBatch.from_arrays([ats, pa.array(heads, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], ["at", "head", "bits"])

    signed = stored(rows.mapInArrow(build, "at bigint, head array<bigint>, bits array<bigint>").join(wanted, "at").select("cls", "head", "bits"))
    blocks = F.ceil(F.col("met") / BLOCK).cast("int")
    dealt = hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "root").join(signed, "cls")
    keys = ["token", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "own", "cls")

    def compare(group: list[dict]) -> Iterator[tuple[int, int, int, int]]:
        first = [r for r in group if r["own"] == r["i"]]
        second = first if group[0]["i"] == group[0]["j"] else [r for r in group if r["own"] == r["j"]]
        n, root = (np.array([r[c] for r in second], np.int64) for c in ("n", "root"))
        bits, heads = np.array([r["bits"] for r in second], np.int64).view(np.uint64), [set(r["head"]) for r in second]
        for k, r in enumerate(first):
            start = k + 1 if second is first else 0
            own = np.array(r["bits"], np.int64).view(np.uint64)  # of a negative number numpy counts the bits of its absolute value
            fit = np.flatnonzero((root[start:] != r["root"]) & (100 * np.minimum(n[start:], r["n"]) >= percent * np.maximum(n[start:], r["n"]))) + start
            most = np.minimum(r["n"] - np.bitwise_count(own & ~bits[fit]).sum(1, dtype=np.int64), n[fit] - np.bitwise_count(~own & bits[fit]).sum(1, dtype=np.int64))
            for x in fit[100 * most >= percent * (r["n"] + n[fit] - most)]:
                if next(t for t in r["head"] if t in heads[x]) == r["token"]:
                    a, b = sorted(((r["cls"], r["n"]), (second[x]["cls"], int(n[x]))))
                    yield a[0], b[0], a[1], b[1]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for r in (r for b in batches for r in b.to_pylist()):
            if group and any(group[0][k] != r[k] for k in keys):
                out += compare(group)
                group = []
            group.append(r)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out + (list(compare(group)) if group else []))

    return dealt.select(*keys, "own", "cls", "n", "root", "head", "bits").mapInArrow(tiles, "a bigint, b bigint, n_a bigint, n_b bigint").distinct()


def _pairs(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n_a", "n_b"])


def class_links(docs: DataFrame, signs: DataFrame, words: int, percent: int, whole: bool = False) -> DataFrame:
    """Verified links between classes that join exactly what all links join; all links if ``whole``."""
    common = common_shingles(docs, words)
    hits = shared_prefixes(docs, words, percent, common)
    stars = None if whole else stored(verified(overlap_bound(_star_pairs(hits, percent), _classes(signs), percent), docs, signs, words, percent))
    named = _between(hits, None if whole else components(stars))
    rest = overlap_bound(_tile_pairs(named, percent), _classes(signs), percent)
    rest = rest.unionByName(_hot_pairs(named, docs, signs, words, percent, common)).distinct()
    rest = verified(rest, docs, signs, words, percent)
    return rest if whole else stars.union(rest)


def _classes(signs: DataFrame) -> DataFrame:
    return signs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("n").alias("n"), F.first("bits").alias("bits"))


def _numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row number, id and text, stored once, so that every job meets the same numbers."""
    return stored(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.monotonically_increasing_id().alias("at")))


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Row number, id, set size, and the group's class for every document."""
    signs = signatures(rows, words)
    roots = components(class_links(rows, signs, words, percent))
    return signs.join(roots, "cls", "left").select("at", "doc_id", "n", F.coalesce("root", "cls").alias("group"))


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document ``n_shingles`` and ``component_id``, the smallest id its links reach.

    Links join documents whose distinct word shingles reach ``percent`` percent Jaccard similarity. A
    text of fewer words than a shingle is one shingle; a text without words, or null, has none and is
    linked with nothing. Equal texts and repeated rows are one class and linked; a null id never is the
    smallest unless all ids are null; an empty table gives no rows; other columns are not looked at.
    Rows are numbered once and stored with their number. Shingles and sets are compared by 64-bit hashes.
    """
    groups = _grouped(_numbered(docs, text, doc_id), words, percent)
    least = groups.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = groups.join(least, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def jaccard_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link, as pairs (``a``, ``b``) of classes with a < b, and the classes' members.

    Members are all documents with ``n_shingles``, ``class_id`` (equal sets are one class; null without
    words) and ``n_links``, the number of other documents each is linked with. Copies are not expanded:
    a class of c documents stands for c * (c - 1) / 2 links, a pair of classes for the product of their
    sizes. The cost grows with the number of links between different texts, which is quadratic in a
    large group of near copies; ``jaccard_groups`` avoids that where components are enough. Null, empty
    and repeated texts, null ids and an empty table are taken as there.
    """
    rows = _numbered(docs, text, doc_id)
    signs = signatures(rows, words)
    links = stored(class_links(rows, signs, words, percent, whole=True))
    sizes = stored(signs.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("size")))
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a"))
    near = ends.join(sizes.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("near"))
    each = sizes.join(near, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    members = signs.join(each, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return links, members


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each group: that of the smallest id, of equal ids the first row stored.

    Documents without words (null, empty or blank texts) all stay; a null id is kept only where a group
    has no other; repeated rows are one group; an empty table gives no rows; all columns stay as they are.
    """
    rows = placed(docs)
    parts = rows.select("at", F.col("row_").getField(doc_id).alias("doc_id"), F.col("row_").getField(text).alias("text"))
    groups = stored(_grouped(parts, words, percent))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "at"))
    gone = groups.where("group IS NOT NULL").groupBy("group").agg(first["at"].alias("keep"))
    gone = groups.join(gone, "group").where("at != keep").select("at")
    return unpacked(rows.join(gone, "at", "left_anti"), docs.columns, {})

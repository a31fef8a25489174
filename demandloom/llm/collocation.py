"""Phrase collocations: n-grams that Misra-Gries summaries cannot rule out, counted exactly and scored.

Level by level (words, pairs, longer runs) every text gives hashes of those n-grams whose parts are
still in question. They are dealt out by hash partition; each task keeps a mergeable summary of the hashes it
is dealt, which can only lose n-grams below the threshold. What survives is counted in a last pass as text, by a few tasks per core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.columns import stored
from demandloom.llm.shingles import BASE, _mix, _powers, pieces

MOST_WORDS, LEAST, TOP, PERCENT = 5, 100, 2000, 100
BLOCK_ROWS, BLOCK_BYTES, FLUSH, HELD, GIVEN = 4096, 1 << 20, 1 << 20, 1 << 19, 1 << 16
TASKS_PER_CORE = 2
FILTER_BITS = 1 << 24
# Summaries know an n-gram by 44 bits of its hash: 12 name its hash partition, 32 its place there. Equal ones only add up, so none is lost.
PARTITION_BITS, KEY_BITS = 12, 32
NO_LANGUAGE = "und"


class Summary:
    """A Misra-Gries summary of weighted 64-bit keys that loses no key of weight ``least`` or more.

    ``lost`` is what was taken from every count, so a key's true weight lies between its count and its
    count plus ``lost``. The room grows with the mass over ``least``; and where taking more would bring ``lost``
    to ``least``, the summary takes nothing and doubles its room instead. Two summaries of parts merge
    into one of the whole: counts and ``lost`` add up.
    """

    def __init__(self, least: int, room: int = 1 << 14):
        self.least, self.room, self.mass, self.lost = least, room, 0, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        self.mass += int(counts.sum())
        self.lost += lost
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, weights = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        self.keys, self.counts = both[first], np.add.reduceat(weights, first) if len(first) else weights
        self.room = max(self.room, 4 * self.mass // self.least)
        while len(self.keys) > self.room:
            taken = int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1])
            if self.lost + taken >= self.least:
                self.room *= 2
                continue
            self.lost += taken
            kept = self.counts > taken
            self.keys, self.counts = self.keys[kept], self.counts[kept] - taken

    def survivors(self) -> np.ndarray:
        """Every key that can weigh ``least``."""
        return self.keys[self.counts + self.lost >= self.least]


class Block:
    """Words of a few texts as numpy arrays: bounds in the joined bytes, piece, language and hash of each."""

    def __init__(self, texts: list[str | None], langs: list[str | None], seeds: dict[str, int]):
        langs = [NO_LANGUAGE if x is None else x for x in langs]
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)  # a line end parts pieces, so it parts texts too
        self.low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        stop = np.isin(self.low, np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8))
        word = ~(stop | (self.low == 32) | (self.low == 9))
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        self.first, self.last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(stop)[self.first] if len(self.first) else np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        self.doc = np.searchsorted(starts, self.first, "right") - 1
        self.names = sorted(set(langs))
        for x in self.names:
            seeds.setdefault(x, int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little"))
        code = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([code[x] for x in langs], np.int64)[self.doc] if len(self.first) else np.zeros(0, np.int64)
        self.seed = np.array([seeds[x] for x in self.names], np.uint64)[self.lang] if len(self.first) else np.zeros(0, np.uint64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        up, down = powers(len(self.low))
        total = np.r_[np.uint64(0), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], dtype=np.uint64)]
        return _mix((total[self.last] - total[self.first]) * down[self.first] + (self.last - self.first).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of ``n`` words inside a piece, and the runs' hashes, which tell languages apart."""
        k = max(0, len(self.hash) - n + 1)
        whole = np.zeros(k, np.uint64)
        for j in range(n):
            whole = whole * np.uint64(BASE) + self.hash[j : j + k]
        inside = np.flatnonzero(self.piece[:k] == self.piece[n - 1 : n - 1 + k])
        return inside, _mix(_mix(whole[inside] + np.uint64(n)) ^ self.seed[inside])

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.first[at : at + n], self.last[at : at + n], strict=True)).decode()


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the worker's next block."""
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [_powers(BASE, max(n, BLOCK_BYTES + BLOCK_ROWS)), _powers(pow(BASE, -1, 2**64), max(n, BLOCK_BYTES + BLOCK_ROWS))]
    return _tables[0], _tables[1]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of (text, lang) rows. A text longer than a block is cut where a piece ends."""
    seeds: dict[str, int] = {}
    for b in (x for batch in batches for x in pieces(batch, 0, BLOCK_ROWS, BLOCK_BYTES)):
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        if len(texts) > 1 or len(texts[0] or "") <= BLOCK_BYTES:
            yield Block(texts, langs, seeds)
            continue
        text, at = texts[0], 0
        while at < len(text):
            end = at + BLOCK_BYTES
            if end < len(text):
                last = max(text.rfind(c, at, end) for c in ".,;:!?\n\x0b\x0c\r")
                nexts = [i for c in ".,;:!?\n\x0b\x0c\r" if (i := text.find(c, end)) >= 0] if last < 0 else []
                end = last + 1 if last >= 0 else min(nexts, default=len(text)) + 1
            yield Block([text[at:end]], langs, seeds)
            at = end


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    least = np.uint64(FILTER_BITS - 1)
    return hashes & least, (hashes >> np.uint64(PARTITION_BITS + KEY_BITS - 24)) & least


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    one, two = ((bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1 for x in places(hashes))
    return one & two


def open_grams(block: Block, n: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the block whose parts pass the filters of the levels below: words for pairs, pairs for longer runs."""
    first, hashes = block.grams(n)
    part = min(n - 1, 2)
    if part and len(filters) >= part:
        at, own = block.grams(part)
        good = np.zeros(len(block.hash) + 1, bool)
        good[at] = passes(own, filters[part - 1])
        keep = np.ones(len(first), bool)
        for j in range(n - part + 1):
            keep &= good[first + j]
        first, hashes = first[keep], hashes[keep]
    return first, hashes


def surviving(rows: DataFrame, sizes: list[int], filters: list, least: int) -> np.ndarray:
    """The bit filter of the n-grams of these sizes that summaries cannot rule out. It has a fixed size; where more survive, more pass it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, held = [f.value for f in filters], [], 0

        def counted() -> pa.RecordBatch:
            """A row per hash partition: the 32-bit keys of its n-grams and how often each was found."""
            mask = np.uint64((1 << PARTITION_BITS + KEY_BITS) - 1)
            keys, n = np.unique(np.concatenate(found) & mask if found else np.zeros(0, np.uint64), return_counts=True)
            parts, first = np.unique(keys >> np.uint64(KEY_BITS), return_index=True)
            ends = pa.py_buffer((4 * np.append(first, len(keys))).astype(np.int32))
            packed = [pa.Array.from_buffers(pa.binary(), len(parts), [None, ends, pa.py_buffer(x.astype("<u4"))]) for x in (keys & np.uint64((1 << KEY_BITS) - 1), n)]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *packed], ["part", "keys", "n"])

        for block in blocks(batches):
            for n in sizes:
                found.append(open_grams(block, n, known)[1])
                held += len(found[-1])
            if held > FLUSH:
                yield counted()
                found.clear()
                held = 0
        yield counted()

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, found, held = Summary(least), [], 0
        for b in batches:
            keys, n = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").astype(np.int64) for i in (1, 2))
            sizes_ = pc.binary_length(b.column(1)).to_numpy() // 4
            found.append([np.repeat(b.column(0).to_numpy().astype(np.int64), sizes_) << KEY_BITS | keys, n])
            held += len(keys)
            if held > FLUSH:
                summary.merge(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if found:
            summary.merge(*map(np.concatenate, zip(*found, strict=True)))
        bits = np.zeros(FILTER_BITS, bool)
        for x in places(summary.survivors().view(np.uint64)):
            bits[x.astype(np.int64)] = True
        table = np.packbits(bits, bitorder="little").view(np.int64)
        words = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(table[words])], ["word", "bits"])

    dealt = rows.mapInArrow(hashed, "part int, keys binary, n binary").repartition("part")
    words = dealt.mapInArrow(summarised, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


class Held:
    """Counts of n-grams by hash; the text of each is kept once."""

    NAMES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string())])

    def __init__(self):
        self.keys, self.counts, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[pa.RecordBatch] = []

    def add(self, block: Block, n: int, first: np.ndarray, hashes: np.ndarray) -> None:
        keys, at, times = np.unique(hashes, return_index=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        old = np.r_[self.keys, np.uint64(0)][place] == keys
        old &= place < len(self.keys)
        self.counts[place[old]] += times[old]
        at = first[at[~old]].tolist()
        if not at:
            return
        columns = [[block.names[block.lang[i]] for i in at], [n] * len(at), [block.phrase(i, n) for i in at]]
        self.names.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.NAMES.types, strict=True)], schema=self.NAMES))
        slots = np.arange(len(self.keys), len(self.keys) + len(at))
        self.keys, self.counts, self.slots = (np.insert(x, place[~old], y) for x, y in ((self.keys, keys[~old]), (self.counts, times[~old]), (self.slots, slots)))

    def taken(self, up_to: int) -> Iterator[pa.RecordBatch]:
        """The n-grams found ``up_to`` times or less, which are held no longer."""
        out, names = self.counts <= up_to, pa.Table.from_batches(self.names, self.NAMES).combine_chunks()
        given = names.take(pa.array(self.slots[out])).append_column("n", pa.array(self.counts[out]))
        self.names = names.take(pa.array(self.slots[~out])).to_batches()
        self.keys, self.counts, self.slots = self.keys[~out], self.counts[~out], np.arange(int((~out).sum()))
        yield from given.to_batches(max_chunksize=GIVEN)


def exact_counts(rows: DataFrame, filters: list, most_words: int) -> DataFrame:
    """(lang, size, phrase, n) of every n-gram that passes the filters, counted as text.

    Each task gives out each n-gram it holds once, and a frequent one is found nearly everywhere. So there
    are a few tasks per core, however many parts the input has: a task per part would give rows that
    grow with the parts times the n-grams, and both grow with the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = [f.value for f in filters], Held()
        for block in blocks(batches):
            for n in range(1, most_words + 1):
                first, hashes = open_grams(block, n, known)
                good = passes(hashes, known[min(n, 3) - 1])
                held.add(block, n, first[good], hashes[good])
            if len(held.keys) > HELD:  # frequent ones stay, so that each task gives them out once
                yield from held.taken(int(np.median(held.counts)))
        yield from held.taken(int(held.counts.max(initial=0)))

    few = rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(count, "lang string, size int, phrase string, n bigint")
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def word_totals(rows: DataFrame) -> DataFrame:
    """(lang, n) with all word occurrences."""
    none, stops = F.coalesce("text", F.lit("")), "[.,;:!?\\x0A-\\x0D \\t]+"
    n = F.size(F.array_remove(F.split(none, stops), ""))
    return rows.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), n.cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, size, phrase, n) of all words and phrases found ``least`` times or more in a language, and (lang, n) of its words.

    Exact: a summary keeps every n-gram that can reach ``least``, an n-gram is never more frequent than
    its parts, and what is left is counted as text. Inside a block occurrences are gathered by 64-bit hash.
    """
    rows = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    send: Callable = docs.sparkSession.sparkContext.broadcast
    filters: list = []
    for sizes in ([1], [2], list(range(3, most_words + 1))):
        filters.append(send(surviving(rows, sizes, filters, least)))
    found = stored(exact_counts(rows, filters, most_words).where(F.col("n") >= least))
    return found, word_totals(rows)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut that scores lowest (the
    first of equal ones), ``n`` the language's words, the score floor(1000 a n / (l r)), in exact decimals. A phrase
    inside a longer one of at least ``percent`` percent of its count is left out. Ranked by score, count, then phrase.

    A null text has no words and a null language is ``und``; repeated rows count again; an empty table
    gives no rows; other columns are not looked at. Memory grows with the longest piece of a text, not with the text.
    """
    found, totals = phrases(docs, text, lang, most_words, least)
    words = F.split("phrase", " ")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    joined = lambda begin, length: F.array_join(F.slice(words, begin, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    # Sums of products stay below 38 digits while a language has fewer than 10^17 words.
    lowest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # A phrase one word longer is at least as frequent as any still longer one, so it decides alone.
    inner = candidates.where("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))

"""Alignment of two tokenizers' tokens over the bytes of the same text.

Tokens and bytes, or tokens and groups, make incidence matrices in compressed rows (CSR) built by hand.
Row products A x B transposed, formed as Gustavson does by gathering the rows of the right matrix that a
row of the left one names, give the links: tokens that share a byte, or that share a group between two
places where tokens of both end.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import stored
from demandloom.llm.shingles import pieces
from demandloom.llm.tokencount import PLAIN

SLICE_ROWS, SLICE_BYTES, EXPANDED, PART, FLUSH, FREQUENT = 256, 1 << 20, 1 << 22, 1 << 18, 1 << 20, 1 << 19


@dataclass
class Csr:
    """A sparse matrix: the entries of row i are ``columns`` and ``values`` from ``bounds[i]`` to ``bounds[i + 1]``."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def incidence(rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """The matrix that counts how often each (row, column) is given."""
        return Csr._summed(rows * width + columns, np.ones(len(rows), np.int64), height, width)

    @staticmethod
    def _summed(places: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
        places, values = combined(places, values)
        rows = places // width
        return Csr(np.searchsorted(rows, np.arange(height + 1)), places - rows * width, values, width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def times(self, other: Csr) -> Csr:
        """The product: each entry (i, k) adds ``other``'s row k to row i. Entries are taken in runs that expand to about ``EXPANDED`` products."""
        rows, sizes = self.rows(), np.diff(other.bounds)[self.columns]
        ends, done, i = np.cumsum(sizes), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + EXPANDED, "right")))
            n = sizes[i:j]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(other.bounds[self.columns[i:j]], n) + inside
            part = np.repeat(rows[i:j], n) * other.width + other.columns[at], np.repeat(self.values[i:j], n) * other.values[at]
            done = combined(*map(np.concatenate, zip(done, part, strict=True)))
            i = j
        return Csr._summed(*done, len(self.bounds) - 1, other.width)


def combined(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places with the sums of their values."""
    order = np.argsort(places, kind="stable")
    places, values = places[order], values[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, np.int64)
    return places[first], np.add.reduceat(values, first) if len(first) else values


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: how many bytes they share. Both cover the same bytes."""
    length = int(a_ends[-1]) if len(a_ends) else 0
    a = Csr(np.r_[0, a_ends], np.arange(length), np.ones(length, np.int64), max(1, length))
    b = np.searchsorted(b_ends, np.arange(length), "right")
    return a.times(Csr(np.arange(length + 1), b, np.ones(length, np.int64), max(1, len(b_ends))))


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens of both end, and the group between two such places of each token of A and of B."""
    cuts = np.intersect1d(a_ends, b_ends)
    return cuts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def group_links(a_keys: np.ndarray, a_groups: np.ndarray, b_keys: np.ndarray, b_groups: np.ndarray, groups: int, height: int, width: int) -> Csr:
    """Keys of A by keys of B: in how many ways a token of the one shares a group with a token of the other."""
    a = Csr.incidence(a_keys, a_groups, height, max(1, groups))
    return a.times(Csr.incidence(b_groups, b_keys, groups, width))


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; loaded in each worker from files every executor can read.

    ``ranks``, the byte-level vocabulary as ranks, is a faster way to the same tokens for texts whose
    characters all Unicode tables class alike; other texts take the library of ``a``.
    """

    def __init__(self, a: str, b: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.fast = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), None
        self.a.encode_special_tokens = True
        decoded = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(decoded[c] for c in token) if all(c in decoded for c in token) else token.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.a_size, self.b_size = len(self.a_bytes), size
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            if all(self.a_bytes[i] == x for x, i in table.items()):
                self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.digits = np.array([[f"{i}{x}" for i in range(max(self.a_size, self.b_size))] for x in (",", "|", ";", "")], object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none of either where the bytes of one do not spell blank and text."""
        slow = [i for i, t in enumerate(texts) if t and not (self.fast and PLAIN.fullmatch(t))]
        a = [self.fast.encode_ordinary(" " + t) if t and self.fast else [] for t in texts]
        for i, e in zip(slow, self.a.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            a[i] = e.ids
        b = self.b.encode(texts, num_threads=1) if texts else []
        for i, t in enumerate(texts):
            want = (" " + t).encode()
            if not t or b"".join([self.a_bytes[x] for x in a[i]]) != want or b"".join([self.b_bytes[x] for x in b[i]]) != want:
                a[i], b[i] = [], []
        return a, b


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}


def aligned_texts(both: Tokenizers, texts: list[str], links: str = "group") -> list[dict]:
    """For each text its numbers of tokens, groups and links, the groups as text, and its id pairs with their links.

    All texts are aligned as one run of bytes: a text's end is a place where tokens of both end.
    """
    a, b = both.encode(texts)
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    a_ids, b_ids = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
    a_ends, b_ends = np.cumsum(both.a_length[a_ids]), np.cumsum(both.b_length[b_ids])
    cuts, a_groups, b_groups = groups_of(a_ends, b_ends)
    a_doc = np.repeat(np.arange(len(texts)), n_a)
    heads, a_keys = np.unique(a_doc * both.a_size + a_ids, return_inverse=True)
    if links == "group":
        found = group_links(a_keys, a_groups, b_ids, b_groups, len(cuts), len(heads), both.b_size)
        rows, columns, ways = found.rows(), found.columns, found.values
    else:
        met = overlap_links(a_ends, b_ends)
        at, ways = combined(a_keys[met.rows()] * both.b_size + b_ids[met.columns], np.ones(len(met.columns), np.int64))
        rows, columns = at // both.b_size, at % both.b_size
    doc_of, keys = heads[rows] // both.a_size, (heads[rows] % both.a_size) * both.b_size + columns
    bounds = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    # The ids in the order of group, side and place, each with the mark that follows it.
    side = np.concatenate([2 * a_groups, 2 * b_groups + 1])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([a_ids, b_ids])[order]
    ends = np.r_[side[1:] != side[:-1], True] if len(side) else np.zeros(0, bool)
    marks = np.where(ends, 1 + side % 2, 0)
    text_ends = np.cumsum(n_a + n_b)
    marks[text_ends[(n_a + n_b) > 0] - 1] = 3
    written = both.digits[marks, ids] if len(ids) else ids
    group_docs = np.searchsorted(cuts, np.cumsum([both.a_length[x].sum() if x else 0 for x in a]), "right") if len(texts) else []
    out = []
    for i in range(len(texts)):
        lo, hi = bounds[i], bounds[i + 1]
        begin = text_ends[i] - n_a[i] - n_b[i]
        out.append({
            "n_a": int(n_a[i]), "n_b": int(n_b[i]), "n_groups": int(group_docs[i] - (group_docs[i - 1] if i else 0)), "n_links": int(ways[lo:hi].sum()),
            "groups": "".join(written[begin : text_ends[i]].tolist()), "keys": keys[lo:hi], "ways": ways[lo:hi],
        })
    return out


def aligned(docs: DataFrame, paths: tuple[str, ...], text: str = "text", doc_id: str = "doc_id", links: str = "group", digest: bool = False) -> DataFrame:
    """Rows (at, doc_id, n_a, n_b, n_groups, n_links, groups, keys, ways), stored: every document's alignment.

    ``keys`` are the id pairs linked in the document, as A id times B's size plus B id, ``ways`` how many
    links each stands for. ``groups`` is ``a1,a2|b1;a3|b2`` by group, or its SHA-256 with ``digest``. A document of more than
    ``PART`` pairs goes on in rows that have only at, keys and ways. ``links`` is ``group`` or ``overlap``.
    ``paths``: byte-level file, piece model and, if wanted, the ranks file, on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(*paths)
        names = ["at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "ways"]
        for b in (x for batch in batches for x in pieces(batch, 2, SLICE_ROWS, SLICE_BYTES)):
            rows = aligned_texts(both, [t or "" for t in b.column(2).to_pylist()], links)
            own = [pa.array([r[c] for r in rows], pa.int64()) for c in names[2:6]]
            texts = pa.array([hashlib.sha256(r["groups"].encode()).hexdigest() if digest and r["groups"] else r["groups"] for r in rows], pa.string())
            lists = [pa.array([r[c][:PART] for r in rows], pa.list_(pa.int64())) for c in ("keys", "ways")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, texts, *lists], names)
            for i, r in enumerate(rows):
                for k in range(PART, len(r["keys"]), PART):
                    rest = [pa.array([r[c][k : k + PART]], pa.list_(pa.int64())) for c in ("keys", "ways")]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.nulls(1, b.column(1).type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *rest], names)

    # Numbers are given in the one pass whose rows are stored, so every later job meets the same ones.
    rows = docs.select(F.monotonically_increasing_id().alias("at"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"at bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, keys array<bigint>, ways array<bigint>"))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(key, n, best) of every linked id pair, stored: how many documents hold it, and whether none with its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

        for b in batches:
            for i in range(0, b.num_rows, SLICE_ROWS):
                held.append(b.column(0).slice(i, SLICE_ROWS).flatten().to_numpy())
                n += len(held[-1])
                if n > FLUSH:
                    yield counted()
                    held.clear()
                    n = 0
        yield counted()

    pairs = rows.select("keys").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("a", F.expr(f"key div {b_size}")))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return stored(pairs.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent_pairs(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and signed counts (negative where not best) of the pairs above the count that at most ``most`` reach."""
    step, kept, least = F.floor(F.log2("n") * 16).cast("int"), 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect(), key=lambda r: -r["step"]):
        kept += r["pairs"]
        if kept > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pairs.where(step >= least).select("key", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n")).toArrow()
    keys = table["key"].to_numpy()
    order = np.argsort(keys)
    return keys[order], table["n"].to_numpy()[order]


def align(docs: DataFrame, paths: tuple[str, ...], b_size: int, text: str = "text", doc_id: str = "doc_id", links: str = "group", digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``n_best`` are the links whose id pair is held by as many documents as any with its A id, ``count_sum``
    is the sum over links of how many documents hold their pair. ``b_size`` is B's number of ids. At most
    ``frequent`` pairs are a table in every task, the others are joined; the bound never changes a result.

    A text that is null or empty, or that the tokens' bytes do not spell, has no tokens: zeros and an
    empty text. Repeated rows, equal and null ids give a row each and each counts as a document; an empty table gives no rows;
    very long texts are aligned whole; other columns are not looked at.
    """
    rows = aligned(docs, paths, text, doc_id, links, digest)
    pairs = pair_counts(rows, b_size)
    table = docs.sparkSession.sparkContext.broadcast(frequent_pairs(pairs, frequent))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (at, count_sum, n_best) per row with what the table knows; rows (at, key, ways) of the pairs it does not."""
        known, counts = table.value
        names = ["at", "count_sum", "n_best", "key", "ways"]
        none = lambda n: pa.nulls(n, pa.int64())
        for b in (x.slice(i, SLICE_ROWS) for x in batches for i in range(0, x.num_rows, SLICE_ROWS)):
            sizes = np.diff(b.column(1).offsets.to_numpy())
            row, keys, ways = np.repeat(np.arange(b.num_rows), sizes), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            n = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], row, ways * np.abs(n))
            np.add.at(sums[1], row, ways * (n > 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[0]), pa.array(sums[1]), none(b.num_rows), none(b.num_rows)], names)
            if not hit.all():
                left = row[~hit]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(left)), none(len(left)), none(len(left)), pa.array(keys[~hit]), pa.array(ways[~hit])], names)

    seen = rows.select("at", "keys", "ways").mapInArrow(look_up, "at bigint, count_sum bigint, n_best bigint, key bigint, ways bigint")
    seen = stored(seen)
    rest = seen.where("key IS NOT NULL").select("at", "key", "ways").join(pairs, "key")
    rest = rest.select("at", (F.col("ways") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("ways")).otherwise(F.lit(0)).cast("long").alias("n_best"))
    parts = seen.where("key IS NULL").select("at", "count_sum", "n_best").unionByName(rest)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    facts = rows.select("at", *own).withColumns({"count_sum": F.lit(0).cast("long"), "n_best": F.lit(0).cast("long")})
    empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in own}
    total = facts.unionByName(parts.withColumns(empty)).groupBy("at").agg(*[F.max(c).alias(c) for c in own if c != "n_links"], F.sum("n_links").alias("n_links"), F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return total.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")

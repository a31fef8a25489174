"""Exact token counts of a byte-level BPE tokenizer, without token ids.

Every distinct pre-token of the corpus is encoded once. A document's count is the sum over its
pre-tokens of frequency times pieces: the most frequent ones from a table of bounded size that every
task holds, the rest by a join on the pre-token.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import stored

# The published pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Beyond these characters Unicode tables of different age disagree; such texts take the library's splitter.
PLAIN = re.compile("[\x00-԰‐-‧€]*")
COMMON, FLUSH, LIMIT = 1 << 18, 400_000, 1024


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check(path: str) -> list[str]:
    """The added tokens of a byte-level BPE file; other kinds of tokenizers are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens", [])
    if not plain or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("only byte-level BPE tokenizers without a normalizer are counted by pre-token")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def splitter(path: str, added: list[str]) -> Callable[[str], tuple[list[str], int]]:
    """Text to its pre-tokens and the number of added tokens, whose strings the library takes whole."""
    import regex

    find, own = regex.compile(PATTERN).findall, []
    marks = re.compile("|".join(map(re.escape, added))) if added else None

    def pieces(text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return find(text)
        if not own:
            own.append(_tokenizer(path).pre_tokenizer)
        return [text[a:b] for _, (a, b) in own[0].pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        if marks is None or not marks.search(text):
            return pieces(text), 0
        parts = marks.split(text)
        return [p for part in parts if part for p in pieces(part)], len(parts) - 1

    return split


def vocabulary(docs: DataFrame, text: str, path: str, added: list[str]) -> DataFrame:
    """Distinct pre-tokens with corpus frequency ``n`` and number of ``pieces``, each encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path, added), Counter()
        rows = lambda: pa.RecordBatch.from_pydict({"token": pa.array(list(seen.keys()), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split(t or "")[0])
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            found = [len(e.ids) for e in tokenizer.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], ["token", "n", "pieces"])

    distinct = docs.select(text).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return stored(distinct.mapInArrow(encode, "token string, n bigint, pieces int"))


def frequent(vocab: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all those above the frequency that at most ``most`` reach."""
    step = F.floor(F.log2("n") * 16).cast("int")
    kept, least = 0, None
    for r in sorted(vocab.groupBy(step.alias("step")).agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["step"]):
        kept += r["tokens"]
        if kept > most:
            break
        least = r["step"]
    if least is None:
        return {}
    return dict(map(tuple, vocab.where(step >= least).select("token", "pieces").collect()))


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """Per document ``n_bytes``, ``n_tokens`` and ``over_limit``: more tokens than ``limit``.

    ``path`` must be readable on every executor. ``common`` bounds the table that the driver gathers and
    every task holds; it moves work between that table and the join and never changes a count. ``docs`` should come from stored data
    (a table or a checkpoint), because its texts are read twice; its rows are numbered in one pass.
    A null or empty text has no bytes and no tokens; repeated rows, equal or null ids give a row each;
    an empty table gives no rows; other columns are not looked at.
    """
    added = check(path)
    vocab = vocabulary(docs, text, path, added)
    table = docs.sparkSession.sparkContext.broadcast(frequent(vocab, common))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (at, n, doc_id, n_bytes) per document, n with what the table knows; rows (token, ats, ns) of the pre-tokens it does not."""
        split, known, held, n = splitter(path, added), table.value.get, defaultdict(list), 0
        names, pairs, kind = ["at", "n", "token", "ats", "ns", "doc_id", "n_bytes"], pa.list_(pa.int64()), None
        none = lambda k: [pa.nulls(k, pa.string()), pa.nulls(k, pairs), pa.nulls(k, pairs)]

        def others() -> pa.RecordBatch:
            lists = [pa.array([v[i::2] for v in held.values()], pairs) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(list(held), pa.string()), *lists, pa.nulls(len(held), kind), pa.nulls(len(held), pa.int64())], names)

        for b in batches:
            got, kind = [], b.column(2).type
            for at, t in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                found, marks = split(t)
                each = list(map(known, found))
                if None in each:
                    for token, k in Counter([x for x, v in zip(found, each, strict=True) if v is None]).items():
                        held[token] += (at, k)
                        n += 1
                    each = filter(None, each)
                got.append(marks + sum(each))
                if n > FLUSH:
                    yield others()
                    held.clear()
                    n = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), *none(b.num_rows), b.column(2), b.column(3)], names)
        if held:
            yield others()

    # Numbers are given in the one pass whose rows are stored, so every later job meets the same ones.
    filled = F.coalesce(docs[text], F.lit(""))
    placed = docs.select(F.monotonically_increasing_id().alias("at"), filled.alias("text"), docs[doc_id].alias("doc_id"), F.octet_length(filled).cast("long").alias("n_bytes"))
    kind = placed.schema["doc_id"].dataType
    passed = stored(placed.mapInArrow(sums, f"at bigint, n bigint, token string, ats array<bigint>, ns array<bigint>, doc_id {kind.simpleString()}, n_bytes bigint"))
    known = passed.where("token IS NULL").select("at", "n", "doc_id", "n_bytes")
    other = passed.where("token IS NOT NULL").select("token", "ats", "ns").join(vocab.select("token", "pieces"), "token")
    other = other.select("pieces", F.explode(F.arrays_zip("ats", "ns")).alias("x"))
    other = other.select(F.col("x.ats").alias("at"), (F.col("x.ns") * F.col("pieces")).alias("n"))
    parts = known.unionByName(other.withColumns({"doc_id": F.lit(None).cast(kind), "n_bytes": F.lit(None).cast("long")}))
    total = parts.groupBy("at").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

r"""Chat formatting by columnar byte assembly.

A turn is ``### role: text</turn>`` and a line end. Inside roles and texts a backslash goes before each
backslash and each control string, and before the colon of a role, so the text can be read back as it
was. Segment lengths, offsets and scatter indices of a slice of turns are numpy arrays; headers and
contents are copied into one buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import stored
from demandloom.llm.shingles import pieces

START, MIDDLE, END = "### ", ": ", "</turn>\n"
IN_TEXT, IN_ROLE = r"(\\|### |</turn>)", r"(\\|:|### |</turn>)"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNED = "assistant"
SLICE_ROWS, SLICE_BYTES, PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20, 1 << 15, 1 << 22


def escaped(texts: pa.Array, controls: str = IN_TEXT) -> pa.Array:
    return pc.replace_substring_regex(texts, controls, r"\\\1")


def plain(text: str) -> str:
    """The text as it was before escaping."""
    return ESCAPED.sub(r"\1", text)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text by its marks."""
    at = 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        yield plain(turn[1]), plain(turn[2])
        at = turn.end()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text array, and where each text begins and ends."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> None:
    """Bytes ``begin`` to ``begin + length`` of the source, for each segment, to its place."""
    before = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    out[np.repeat(to, lengths) + inside] = source[np.repeat(begin, lengths) + inside]


def assembled(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The formatted conversations that begin at the rows ``firsts``, and the code point spans of their learned texts."""
    n, coded = len(texts), roles.dictionary_encode()
    names = escaped(coded.dictionary, IN_ROLE).to_pylist()
    heads, head_at = _bytes(pa.array([f"{START}{r}{MIDDLE}" for r in names], pa.string()))
    kind = coded.indices.to_numpy()
    content, content_at = _bytes(escaped(texts))
    tail = np.frombuffer(END.encode(), np.uint8)
    head_len, text_len, tail_len = (head_at[1:] - head_at[:-1])[kind], np.diff(content_at), np.full(n, len(tail))
    begin = np.concatenate([[0], np.cumsum(head_len + text_len + tail_len)])
    out = np.empty(int(begin[-1]), np.uint8)
    _copy(out, begin[:-1], heads, head_at[:-1][kind], head_len)
    text_to = begin[:-1] + head_len
    _copy(out, text_to, content, content_at[:-1], text_len)
    _copy(out, text_to + text_len, tail, np.zeros(n, np.int64), tail_len)
    rows = np.append(firsts, n)
    formatted = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(begin[rows].astype(np.int32)), pa.py_buffer(out))
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    learned = np.array([x == LEARNED for x in coded.dictionary.to_pylist()], bool)[kind] if n else np.zeros(0, bool)
    own = chars[np.repeat(begin[firsts], np.diff(rows))]  # where the row's conversation begins
    spans = [pa.array((chars[x] - own)[learned].astype(np.int32)) for x in (text_to, text_to + text_len)]
    counts = np.concatenate([[0], np.cumsum(learned)])[rows].astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(spans, ["start", "end"]))


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, part, whole, n_turns, formatted, loss): the conversations' formatted texts in pieces.

    ``formatted`` is the conversation's text where ``whole`` is true; other conversations (those at the
    ends of a task's range, and those over ``PIECE_BYTES``) are their pieces in the order of ``part``.
    ``loss`` has (start, end) in code points of the piece, one span for each text of the assistant, without its marks.
    Rows are dealt out by ranges of conversation and turn, so a conversation of any length is spread over tasks.

    A null text or role counts as empty; rows with a null id are one conversation; a null turn comes
    first, and rows of one turn come by role, then by hash of the text; repeated rows are turns of
    their own; an empty table gives no rows; other columns are not looked at.
    """
    filled = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    own = rows.select(rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    kind = own.schema["conv_id"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Conversations at the ends of the task's rows, or too long for a piece, have pieces elsewhere.
        part, split, held = TaskContext.get().partitionId() << 33, set(), None

        def given(rows: pa.RecordBatch, ids: list, firsts: list[int]) -> pa.RecordBatch:
            nonlocal part
            formatted, loss = assembled(rows.column(1), rows.column(2), np.array(firsts, np.int64))
            n = len(firsts)
            made = [rows.column(0).take(pa.array(firsts)), pa.array(np.arange(part, part + n)), pa.array([ids[i] not in split for i in firsts]),
                    pa.array(np.diff([*firsts, len(ids)]).astype(np.int64)), formatted, loss]
            part += n
            return pa.RecordBatch.from_arrays(made, ["conv_id", "part", "whole", "n_turns", "formatted", "loss"])

        def firsts_of(ids: list) -> list[int]:
            return [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]

        for b in (x for batch in batches for x in pieces(batch, 2, SLICE_ROWS, SLICE_BYTES)):
            if held is None and not split:
                split.add(b.column(0)[0].as_py())
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            ids = rows.column(0).to_pylist()
            firsts = firsts_of(ids)
            if len(firsts) > 1:
                yield given(rows.slice(0, firsts[-1]), ids[: firsts[-1]], firsts[:-1])
                held = rows.slice(firsts[-1])
            elif len(ids) > PIECE_ROWS or rows.nbytes > PIECE_BYTES:
                split = {ids[0]} | set(list(split)[:1])
                yield given(rows, ids, [0])
                held = None
            else:
                held = rows
        if held is not None:
            ids = held.column(0).to_pylist()
            split.add(ids[0])
            yield given(held, ids, [0])

    return own.mapInArrow(assemble, f"conv_id {kind}, part bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<start:int,end:int>>")


def digests(pieces_: DataFrame) -> DataFrame:
    """Per conversation the digest columns, read back from the formatted pieces.

    Whole conversations are digested where they lie. The others meet by id and are streamed piece by
    piece in order: a digest is a chain over the conversation, but no task holds more than a piece of it.
    """
    pieces_ = stored(pieces_)
    kind = pieces_.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, type_ = None, None, [], None

        def finished() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, type_) if type_ else pa.array(c) for c, type_ in zip(columns, (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        for b in (x for batch_ in batches for x in pieces(batch_, 1)):
            type_ = b.column(0).type
            for i, formatted, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or i != now:
                    if state is not None:
                        done.append(finished())
                    now, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = plain(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(done) > 1000:
                yield batch()
                done.clear()
        if state is not None:
            done.append(finished())
            yield batch()

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = ["conv_id", "formatted", "loss"]
    parts = pieces_.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    return pieces_.where("whole").select(*columns).mapInArrow(digest, schema).unionByName(parts.mapInArrow(digest, schema))

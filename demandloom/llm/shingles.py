"""Word shingle hashes of Arrow text batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE, CHUNK = 0x9E3779B97F4A7C15, 1 << 18
LEAST_BITS, MOST_BITS = 10, 18


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of the ``k``-word shingles of texts; A-Z lower-cased, words parted by ASCII white space."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, _powers(BASE, CHUNK), _powers(pow(BASE, -1, 2**64), CHUNK)

    def _room(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)

    def _hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the texts that begin at ``starts`` in ``data``, and the text of each."""
        self._room(len(data))
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(low) + 1, bool)
        edge[starts] = True
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        first = np.flatnonzero(word & (~before | edge[:-1]))
        last = np.flatnonzero(word & (~after | edge[1:]))
        total = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[: len(low)], dtype=np.uint64)]
        hashed = _mix((total[last + 1] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        doc = np.searchsorted(starts, first, "right") - 1
        n = max(0, len(hashed) - self.k + 1)
        whole = np.zeros(n, np.uint64)
        for j in range(self.k):
            whole = whole * np.uint64(BASE) + hashed[j : j + n]
        inside = doc[:n] == doc[self.k - 1 :] if n else np.zeros(0, bool)
        out, of = _mix(whole[inside]), doc[:n][inside]
        counts = np.bincount(doc, minlength=len(starts))
        short = np.flatnonzero((counts > 0) & (counts < self.k))
        if len(short):
            at = np.searchsorted(doc, short)
            extra = np.zeros(len(short), np.uint64)
            for j in range(self.k - 1):
                more = counts[short] > j
                extra[more] = extra[more] * np.uint64(BASE) + hashed[at[more] + j]
            extra = _mix(extra ^ counts[short].astype(np.uint64))
            out, of = np.r_[out, extra], np.r_[of, short]
        return out, of

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text; none for null."""
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            starts = offsets[i:j] - offsets[i]
            # An empty text shares its start with the next one, which then owns what begins there.
            hashes, of = self._hashes(data[offsets[i] : offsets[j]], starts)
            order = np.argsort(of, kind="stable")
            hashes, bounds = hashes[order], np.searchsorted(of[order], np.arange(j - i + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield np.unique(hashes[a:b])
            i = j


def pieces(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``size`` bytes of the text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(i, j - i)
        i = j


def bitmap(hashes: np.ndarray, power: int | None = None) -> np.ndarray:
    """A bit for each hash, in 64-bit words: a map of 2^power bits, or of two to four for each hash.

    The number of words is a power of two, so that a map folds to the length of a shorter one.
    """
    bits = np.zeros(1 << (power or min(MOST_BITS, max(LEAST_BITS, int(len(hashes)).bit_length() + 1))), bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)

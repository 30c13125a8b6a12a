"""Words of whole Arrow columns as arrays of hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Bytes handled at once; about forty times as much memory is in use meanwhile. A longer text is one piece.
PIECE_BYTES = 1 << 21

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
# Everything but ASCII letters and digits and the bytes of longer characters.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (an invertible finaliser)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, start: int = 1) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return mix(np.arange(start, start + n, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTE = seeds(256, 1000)
_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, U64), np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept up to the usual piece."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, PIECE_BYTES + 1)
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, U64(base))
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=U64))
    if size <= PIECE_BYTES + 1:
        _powers = made[0], made[1]
    return made[0], made[1]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    size = int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return buf[offsets[0] :], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``limit`` bytes together, or one row if that is longer."""
    _, offsets = text_buffer(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """``hashes`` of all words in order; those of text i are ``hashes[first[i]:first[i + 1]]``."""

    def __init__(self, column, separators: np.ndarray = WHITESPACE, fold: np.ndarray = LOWER):
        buf, offsets = text_buffer(column)
        self.texts = len(offsets) - 1
        size = len(buf)
        apart = np.ones(size + 2, bool)
        if size:
            np.take(separators, buf, out=apart[1:-1])
        inside = ~apart[1:-1]
        before, after = apart[:-2].copy(), apart[2:].copy()
        bounds = offsets[(offsets > 0) & (offsets < size)]
        before[bounds] = True
        after[bounds - 1] = True
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        power, inverse = _power_tables(size + 1)
        sums = np.zeros(size + 1, U64)
        values = _BYTE[fold[buf]]
        values *= power[:size]
        np.cumsum(values, out=sums[1:])
        self.starts, self.ends = starts, ends
        self.hashes = mix((sums[ends] - sums[starts]) * inverse[starts]) if len(starts) else np.zeros(0, U64)
        self.first = np.searchsorted(starts, offsets).astype(np.int64)
        self.buf, self.offsets = buf, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of ``n`` words and the first one of each text.

        With ``short``, a text of fewer words (but not none) has its whole
        sequence as one shingle; otherwise it has none.
        """
        counts = self.counts
        full = np.maximum(counts - n + 1, 0)
        total = len(self.hashes)
        factors = seeds(n, 77)
        made = np.zeros(max(total - n + 1, 0), U64)
        for k in range(n):
            made += self.hashes[k : k + len(made)] * factors[k]
        made = mix(made)
        position = np.arange(len(made))
        # A run must not reach into the next text.
        keep = np.zeros(total + 1, np.int64)
        np.add.at(keep, self.first[:-1][full > 0], 1)
        np.add.at(keep, (self.first[:-1] + full)[full > 0], -1)
        whole = np.cumsum(keep[: len(made)]) > 0
        sizes = full.copy()
        hashes = made[whole]
        if not short:
            return hashes, np.concatenate([[0], np.cumsum(sizes)])
        few = np.flatnonzero((counts > 0) & (counts < n))
        if not len(few):
            return hashes, np.concatenate([[0], np.cumsum(sizes)])
        sizes[few] = 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(first[-1], U64)
        place = np.ones(len(out), bool)
        place[first[few]] = False
        out[place] = hashes
        for i in few:
            run = self.hashes[self.first[i] : self.first[i + 1]]
            out[first[i]] = mix(np.array([(run * factors[: len(run)]).sum(dtype=U64) + U64(len(run))], U64))[0]
        del position
        return out, first

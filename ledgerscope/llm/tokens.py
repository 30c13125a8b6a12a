"""Hashes of all words of Arrow batches, long texts worked on in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerscope.llm.words import LOWER, PIECE_BYTES, U64, WHITESPACE, Words, pieces, text_buffer


def cuts(buf: np.ndarray, separators: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``limit`` bytes that end behind a separator; one longer word is a stretch of its own."""
    start = 0
    while start < len(buf):
        end = min(start + limit, len(buf))
        if end < len(buf):
            found = np.flatnonzero(separators[buf[start:end]])
            if len(found):
                end = start + int(found[-1]) + 1
            else:
                while end < len(buf):
                    found = np.flatnonzero(separators[buf[end : end + limit]])
                    if len(found):
                        end += int(found[0]) + 1
                        break
                    end = min(end + limit, len(buf))
        yield start, end
        start = end


def word_hashes(column, separators: np.ndarray = WHITESPACE, fold: np.ndarray = LOWER, limit: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and where those of each text begin.

    Words lie between bytes of ``separators`` and are equal if their bytes are
    after ``fold``. A text of more than ``limit`` bytes is hashed in parts cut
    at separators, so that the working arrays stay small beside it.
    """
    buf, offsets = text_buffer(column)
    if len(buf) <= limit:
        words = Words(column, separators, fold)
        return words.hashes, words.first
    hashes, first = [], [0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        count = 0
        for start, end in cuts(buf[a:b], separators, limit):
            data = pa.py_buffer(np.ascontiguousarray(buf[a + start : a + end]))
            part = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, end - start], np.int64)), data])
            hashes.append(Words(part, separators, fold).hashes)
            count += len(hashes[-1])
        first.append(first[-1] + count)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.array(first, np.int64)


def hashed(
    batches: Iterator[pa.RecordBatch], separators: np.ndarray = WHITESPACE, fold: np.ndarray = LOWER, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the hashes of their words and where those of each text begin."""
    for batch in batches:
        for part in pieces(batch, column):
            yield part, *word_hashes(part.column(column), separators, fold)

"""Periodic runs of words, found while the words arrive.

A square is a stretch of words followed by itself; squares of one period that
overlap merge into a run. Words are appended to ``Catchers``. Whenever a block
whose length is a power of two is complete, a catcher is set up at its end. It
compares the words that follow with those one period earlier, for each period
of its size class, and the suffix of the block with that one period earlier.
Comparisons whose first word differs end at once; the others are carried on
with every append. Where both sides together reach one period, a square is
reported, and the stretch of agreement around it is the run.

Periods from L to 2L - 1 belong to blocks of L words (or ``exponent - 1`` times
as many, rounded down to a power of two, as longer runs are met by fewer
catchers): every run of such a period agrees with itself over at least that
many neighbouring words, so the end of a block is among them. That makes less
than one first comparison for each word and size class. Stretches are compared
by sums of hashes in steps that double, so a comparison costs the logarithm of
its length however repetitive the text is; the runs found are then compared
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.tokens import cuts, hashed
from ledgerscope.llm.words import PIECE_BYTES, SAME, U64, WHITESPACE, text_buffer

_BASE = U64(0xA24BAED4963EE407)
# Comparisons set up at once.
_AT_ONCE = 1 << 20


class Catchers:
    """Runs of at least ``exponent`` (2 or more) periods in texts whose words are appended."""

    def __init__(self, exponent: int = 2, capacity: int = 1024):
        if exponent < 2:
            raise ValueError("a run has at least two periods")
        self.exponent = exponent
        self.spread = 1 << ((exponent - 1).bit_length() - 1)
        self.n = 0
        self.words = np.zeros(capacity, U64)
        self.sums = np.zeros(capacity + 1, U64)
        self.powers = np.ones(capacity + 1, U64)
        self._fill_powers(1)
        self.starts = np.zeros(0, np.int64)  # where texts begin
        # Comparisons still going on: block end, period, words agreeing before it, words agreeing from it on.
        self.open = np.zeros((4, 0), np.int64)
        self.runs = [np.zeros((3, 0), np.int64)]  # start, end, period
        # For each word a run found so far that holds it: where that begins, and its period (0: none).
        self.held = np.zeros((2, capacity), np.int64)

    def _fill_powers(self, start: int) -> None:
        steps = np.full(len(self.powers) - start, _BASE)
        self.powers[start:] = self.powers[start - 1] * np.cumprod(steps, dtype=U64)

    def append(self, words: np.ndarray, starts=()) -> None:
        """Add words; ``starts`` are the places among them at which a new text begins (the very first word always does)."""
        if not len(words):
            return
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            size, old = 2 * self.n, len(self.powers)
            self.words = np.resize(self.words, size)
            self.sums = np.resize(self.sums, size + 1)
            self.powers = np.resize(self.powers, size + 1)
            self._fill_powers(old)
            self.held = np.concatenate([self.held, np.zeros((2, size - self.held.shape[1]), np.int64)], axis=1)
        self.words[before : self.n] = words
        with np.errstate(over="ignore"):
            np.cumsum(words * self.powers[before : self.n], dtype=U64, out=self.sums[before + 1 : self.n + 1])
            self.sums[before + 1 : self.n + 1] += self.sums[before]
        fresh = before + np.asarray(starts, np.int64)
        if not before and (not len(fresh) or fresh[0]):
            fresh = np.concatenate([[0], fresh])
        self.starts = np.concatenate([self.starts, fresh])
        self._advance()
        block = 1
        longest = int(np.diff(np.append(self.starts, self.n)).max())
        while block < longest:
            self._catch(before, block)
            self._advance()
            block *= 2

    def _catch(self, before: int, block: int) -> None:
        """Set up the comparisons at all ends of blocks among the new words."""
        step = block * self.spread
        ends = np.arange(-(-max(before, 1) // step) * step, self.n, step)
        room = ends - self.starts[np.searchsorted(self.starts, ends, side="right") - 1]
        ends, room = ends[room >= block], room[room >= block]
        width = min(block, _AT_ONCE)
        rows = max(1, _AT_ONCE // width)
        for i in range(0, len(ends), rows):
            end, most = ends[i : i + rows, None], room[i : i + rows, None]
            for low in range(block, 2 * block, width):
                period = np.arange(low, min(low + width, 2 * block))
                back = end - period
                same = (self.words[np.maximum(back, 0)] == self.words[end]) & (period <= most)
                row, column = np.nonzero(same)
                if len(row):
                    self._open(end[row, 0], period[column], most[row, 0])

    def _open(self, end: np.ndarray, period: np.ndarray, room: np.ndarray) -> None:
        # Inside a run, multiples of its period only find the same run again.
        begins, known = self.held[:, end]
        fresh = (known == 0) | (end - period < begins) | (period % np.maximum(known, 1) != 0)
        end, period, room = end[fresh], period[fresh], room[fresh]
        behind = self._agree(end, period, room - period, -1)
        self.open = np.concatenate([self.open, np.stack([end, period, behind, np.zeros_like(end)])], axis=1)
        if self.open.shape[1] > _AT_ONCE:
            self._advance()

    def _advance(self, last: bool = False) -> None:
        """Carry all comparisons on to the last word there is; those that have ended become runs if they hold a square."""
        end, period, behind, ahead = self.open
        place = np.searchsorted(self.starts, end, side="right")
        limit = np.append(self.starts, self.n)[place]
        # Each run is carried on by one comparison of each period.
        ahead = ahead + self._agree(end + ahead, period, limit - end - ahead, 1)
        going = (end + ahead == self.n) & (limit == self.n) & (not last)
        done = ~going & (behind + ahead >= (self.exponent - 1) * period)
        found = np.stack([end - period - behind, end + ahead, period])[:, done]
        self.runs.append(np.unique(found, axis=1))
        rest = np.stack([end, period, behind, ahead])[:, going]
        _, one = np.unique(np.stack([rest[0] - rest[2], rest[1]]), axis=1, return_index=True)
        self.open = rest[:, one]
        self._hold(self.runs[-1])
        self._hold(np.stack([self.open[0] - self.open[1] - self.open[2], self.open[0] + self.open[3], self.open[1]]))

    def _hold(self, runs: np.ndarray) -> None:
        for start, end, period in runs[:, runs[1] - runs[0] >= 8 * runs[2]].T.tolist():
            if self.held[1, start] != period or self.held[1, end - 1] != period:
                free = self.held[1, start:end] == 0
                self.held[0, start:end][free] = start
                self.held[1, start:end][free] = period

    def _agree(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those a period earlier; at most ``limit``."""
        found = np.zeros(len(at), np.int64)
        failed = np.zeros(len(at), np.int64)

        def try_step(who: np.ndarray, step: int) -> np.ndarray:
            fits = who[found[who] + step <= limit[who]]
            low = at[fits] + found[fits] if way > 0 else at[fits] - found[fits] - step
            lag = period[fits]
            with np.errstate(over="ignore"):
                late = self.sums[low + step] - self.sums[low]
                early = (self.sums[low - lag + step] - self.sums[low - lag]) * self.powers[lag]
            good = fits[late == early]
            found[good] += step
            return good

        step, active = 1, np.flatnonzero(limit > 0)
        while len(active):
            good = try_step(active, step)
            failed[active] = step
            active, step = good, step * 2
        while step > 1:
            step //= 2
            try_step(np.flatnonzero(failed > step), step)
        return found

    def finish(self) -> np.ndarray:
        """All runs as rows ``start, end, period`` with their smallest period, sorted by start, then period."""
        self._advance(last=True)
        start, end, period = np.unique(np.concatenate(self.runs, axis=1), axis=1)
        # A stretch with a smaller period that divides this one is the same run.
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        runs = np.stack([start, end, period])[:, fresh]
        for i in range(runs.shape[1]):
            self._confirm(runs, i)
        runs = np.unique(runs[:, runs[1] - runs[0] >= self.exponent * runs[2]], axis=1)
        return runs[:, np.lexsort((runs[2], runs[0]))].T

    def _confirm(self, runs: np.ndarray, i: int) -> None:
        """Compare a run word by word; should sums of hashes have deceived, keep the longest stretch that agrees."""
        start, end, period = (int(x) for x in runs[:, i])
        differ = np.flatnonzero(self.words[start + period : end] != self.words[start : end - period])
        if len(differ):
            bounds = np.concatenate([[-1], differ, [end - start - period]])
            longest = int(np.argmax(np.diff(bounds)))
            runs[:, i] = start + bounds[longest] + 1, start + bounds[longest + 1] + period, period


def find_runs(words: np.ndarray, first: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all texts (start and end counted over all words) and where those of each text begin."""
    catchers = Catchers(exponent, len(words) + 1)
    filled = np.unique(first[:-1][np.diff(first) > 0])
    catchers.append(words, filled)
    runs = catchers.finish() if len(words) else np.zeros((0, 3), np.int64)
    return runs, np.searchsorted(runs[:, 0], first)


def kept_text(text: np.ndarray, keep: np.ndarray | None) -> bytes:
    """The words of a text joined by one space, without those that are not kept."""
    parts, count = [], 0
    for a, b in cuts(text, WHITESPACE, PIECE_BYTES):
        words = text[a:b].tobytes().split()
        if keep is not None:
            count, words = count + len(words), compress(words, keep[count : count + len(words)].tolist())
        parts.append(b" ".join(words))
    return b" ".join(p for p in parts if p)


def periodic_runs(docs: DataFrame, exponent: int = 2, least_words: int = 2) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``doc_id, text``.

    ``runs`` lists ``start, length, period`` (in words between ASCII white
    space, counted from 0, compared byte by byte), sorted by start, then
    period. Each run has its smallest period, at least ``exponent`` periods and
    ``least_words`` words, and cannot be extended. ``collapsed`` is the text
    without the words that some run holds after its first period, joined by one
    space. Null, empty and blank texts have no words and no runs. Repeated rows
    and null ids keep a row each; a table without rows gives none; other columns
    are ignored. One text is worked on in one task, in about 80 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, first in hashed(batches, fold=SAME):
            runs, at = find_runs(words, first, exponent)
            start, end, period = runs.T
            long_enough = end - start >= least_words
            at = np.concatenate([[0], np.cumsum(long_enough)])[at]
            start, end, period = start[long_enough], end[long_enough], period[long_enough]
            inside = np.zeros(len(words) + 1, np.int64)
            np.add.at(inside, start + period, 1)
            np.add.at(inside, end, -1)
            keep = np.cumsum(inside[:-1]) == 0
            buf, offsets = text_buffer(part.column("text"))
            texts = []
            for i in range(part.num_rows):
                mine = keep[first[i] : first[i + 1]] if at[i + 1] > at[i] else None
                texts.append(kept_text(buf[offsets[i] : offsets[i + 1]], mine))
            base = first[np.searchsorted(first, start, side="right") - 1]
            fields = [pa.array(x, pa.int64()) for x in (start - base, end - start, period)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

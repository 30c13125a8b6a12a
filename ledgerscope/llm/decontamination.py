"""Benchmark decontamination by the random-walk (CGK) embedding.

A walk reads a sequence of words; at every step it writes the word it stands on
and, by a random bit drawn for the step and that word, stays or goes on. Two
walks with the same bits over sequences that differ by few insertions,
deletions and substitutions soon stand on the same words again, so edit
distance turns into Hamming distance between what they wrote.

Locality-sensitive hashing samples some steps of the walk; windows that wrote
the same words there are candidates. Each repetition has its own bits and
steps. A window has the size of the item; the walk from each of the item's
words is in the table, so that it is enough to walk from every ``stride``-th
word of a document, and an edit near the item's beginning does not hide the
rest.

Short items have too few words for walks at any place. They are cut into one
piece more than they may have edits, so that one of the pieces is whole
wherever the item is, and every run of as many words in a document is looked up
among the pieces. Candidates are confirmed by their exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.words import PUNCTUATION, U64, Words, mix, pieces, seeds


@dataclass(frozen=True)
class Settings:
    """An item is found where at most ``max_edits`` (a share) of its words were inserted, deleted or replaced."""

    max_edits: float = 0.2
    steps: int = 16
    sampled: int = 6
    stride: int = 2
    target_recall: float = 0.99
    # Items of fewer words are looked up by pieces, not by walks.
    walk_words: int = 24
    # Walks of this many items at most are handed to the tasks at a time (8 bytes a walk).
    block_walks: int = 2_000_000

    @property
    def repetitions(self) -> int:
        """Enough for the target recall on the shortest items that are walked, with as many edits as are allowed, spread evenly.

        A walk reads about half as many words as it has steps and hits if none
        of them was edited; the walks from one item count as one chance for
        every word read, as neighbouring ones share their words.
        """
        words = self.steps / 2
        hit = (1 - self.max_edits) ** words
        chances = max(1.0, (self.walk_words - words) / self.stride / 2 + 1)
        return max(1, math.ceil(math.log(1 - self.target_recall) / (chances * math.log(1 - hit))))


def sampled_steps(settings: Settings) -> list[np.ndarray]:
    """The steps that each repetition compares; the first is always among them."""
    rng = np.random.default_rng(11)
    return [
        np.sort(np.append(0, 1 + rng.permutation(settings.steps - 1)[: settings.sampled - 1])) for _ in range(settings.repetitions)
    ]


def walks(hashes: np.ndarray, start: np.ndarray, repetition: int, settings: Settings) -> np.ndarray:
    """What walks from ``start`` wrote at the sampled steps, as one number each.

    A walk that leaves its text goes on into the next one, or into blanks after
    the last: what it wrote then matches nothing, or is found not to.
    """
    steps = sampled_steps(settings)[repetition]
    taken = set(steps.tolist())
    factors = seeds(settings.steps, 5000)
    padded = np.concatenate([hashes, np.zeros(settings.steps + 1, U64)])
    bits = mix(padded ^ seeds(1, 4000 + repetition)[0])
    position = start.astype(np.int32)
    written = np.zeros(len(start), U64)
    for step in range(int(steps[-1]) + 1):
        if step in taken:
            written += padded[position] * factors[step]
        advance = (bits >> U64(step)).astype(np.uint8) & np.uint8(1)
        position += advance[position]
    return mix(written)


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for the run of ``size`` words from each word on, as far as there are so many."""
    made = np.zeros(max(len(hashes) - size + 1, 0), U64)
    for k, factor in enumerate(seeds(size, 6000)):
        made += hashes[k : k + len(made)] * factor
    return mix(made)


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edits that turn ``item`` into some run of ``window``: their number, the run's start and end.

    More than ``most`` edits are only told as ``most + 1``.
    """
    n, m = len(item), len(window)
    cost = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(n):
        through = cost[:-1] + (window != item[i])
        skip = cost[1:] + 1
        best = np.minimum(through, skip)
        source = np.where(through <= skip, begin[:-1], begin[1:])
        new = np.concatenate([[i + 1], best])
        source = np.concatenate([[0], source])
        # Words of the window that the item lacks: a running minimum of cost minus place.
        shifted = new - steps
        run = np.minimum.accumulate(shifted)
        first = np.maximum.accumulate(np.where(shifted == run, steps, 0))
        cost, begin = run + steps, source[first]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


@dataclass(frozen=True)
class Table:
    """Walks of a block of items, sorted by what they wrote, for each repetition.

    ``seen`` tells which leading 20 bits occur among them. ``pieces`` has those
    of the short items by their number of words: sorted runs, items, offsets.
    """

    ids: list
    words: list
    written: list
    item: list
    offset: list
    seen: list
    pieces: dict

    def candidates(self, repetition: int, written: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Walk, item and word of the item for all walks that wrote the same."""
        keys = self.written[repetition]
        near = np.flatnonzero(self.seen[repetition][(written >> U64(44)).astype(np.int32)])
        a = np.searchsorted(keys, written[near], side="left")
        b = np.searchsorted(keys, written[near], side="right")
        for w, x, y in zip(near[b > a], a[b > a], b[b > a]):
            for k in range(x, y):
                yield int(w), int(self.item[repetition][k]), int(self.offset[repetition][k])


def build(items: list[tuple[int, str]], settings: Settings) -> Table:
    words = Words(pa.array([t for _, t in items], pa.string()), PUNCTUATION)
    owner = np.repeat(np.arange(words.texts), words.counts)
    start = np.arange(len(words.hashes))
    stop = words.first[1:][owner]
    # A walk that nears the item's end would be held against blanks; the document goes on there.
    use = (stop - start >= settings.steps // 2 + 1) & (words.counts[owner] >= settings.walk_words)
    start, owner = start[use], owner[use]
    written, item, offset, seen = [], [], [], []
    for r in range(settings.repetitions):
        w = walks(words.hashes, start, r, settings)
        order = np.argsort(w, kind="stable")
        written.append(w[order])
        seen.append(np.bincount((w >> U64(44)).astype(np.int64), minlength=1 << 20) > 0)
        item.append(owner[order])
        offset.append((start - words.first[:-1][owner])[order])
    runs = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:])]
    return Table([i for i, _ in items], runs, written, item, offset, seen, short_pieces(runs, settings))


def short_pieces(runs: list[np.ndarray], settings: Settings) -> dict:
    """Pieces of the items under ``walk_words`` by size: their runs in order, the items and the offsets in these."""
    cut = {}
    for item, run in enumerate(runs):
        if len(run) < settings.walk_words:
            bounds = np.linspace(0, len(run), int(settings.max_edits * len(run)) + 2).astype(int).tolist()
            for a, b in zip(bounds, bounds[1:]):
                cut.setdefault(b - a, []).append((runs_of(run[a:b], b - a)[0], item, a))
    out = {}
    for size, rows in cut.items():
        keys, item, offset = (np.array(c, t) for c, t in zip(zip(*rows), (U64, np.int64, np.int64)))
        order = np.argsort(keys, kind="stable")
        out[size] = keys[order], item[order], offset[order]
    return out


def short_places(words: Words, table: Table) -> Iterator[tuple[int, int, int]]:
    """Text, item and begin wherever a text has a piece of a short item; of whole items the first place only."""
    for size, (keys, items, offsets) in table.pieces.items():
        made = runs_of(words.hashes, size)
        a = np.searchsorted(keys, made, side="left")
        hits = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == made)
        text = np.searchsorted(words.first, hits, side="right") - 1
        inside = hits + size <= words.first[text + 1]
        hits, text = hits[inside], text[inside]
        a, b = a[hits], np.searchsorted(keys, made[hits], side="right")
        many = b - a
        k = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        text, item, begin = np.repeat(text, many), items[k], np.repeat(hits, many) - offsets[k]
        whole = np.array([len(run) for run in table.words])[item] == size
        _, first = np.unique(text * len(table.words) + item, return_index=True)
        keep = ~whole
        keep[first] = True
        yield from zip(text[keep].tolist(), item[keep].tolist(), begin[keep].tolist())


def search(column, table: Table, settings: Settings) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Text, item, edits, first and last word and bytes for the best place of each item in each text."""
    words = Words(column, PUNCTUATION)
    start = np.concatenate([np.arange(a, b, settings.stride) for a, b in zip(words.first, words.first[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(start):
        return
    places = {}
    for text, item, begin in short_places(words, table):
        places.setdefault((text, item), set()).add(begin)
    for r in range(settings.repetitions):
        written = walks(words.hashes, start, r, settings)
        for walk, item, offset in table.candidates(r, written):
            text = int(np.searchsorted(words.first, start[walk], side="right")) - 1
            places.setdefault((text, item), set()).add(int(start[walk]) - offset)
    for (text, item), begins in sorted(places.items()):
        run = table.words[item]
        most = int(settings.max_edits * len(run))
        best = None
        done = []
        for begin in sorted(begins):
            if any(abs(begin - d) <= most // 2 for d in done):
                continue
            done.append(begin)
            a = max(words.first[text], begin - 2 * most - 1)
            b = min(words.first[text + 1], begin + len(run) + 2 * most + 1)
            # Few edits leave most of the item's words in the window.
            if np.count_nonzero((run[:, None] == words.hashes[None, a:b]).any(1)) < len(run) - most:
                continue
            edits, x, y = edit_distance(run, words.hashes[a:b], most)
            if edits <= most and (best is None or edits < best[0]):
                best = edits, a + x - words.first[text], a + y - words.first[text]
                if not edits:
                    break
        if best:
            yield text, table.ids[item], best[0], len(run), int(best[1]), int(best[2])


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, edits, item_words, first_word, end_word`` for every item found in a document.

    One row for each document and item, with the place of fewest edits (words
    counted from 0 without case and punctuation). Items are taken in blocks
    of a bounded number of walks, each handed to all tasks that read the
    documents, so neither table is shuffled and no item is left out for size.
    Null or empty texts hold nothing; items that are null or without words are
    not looked for; items under five words are found unedited only; repeated items are found each by its
    id, repeated documents give repeated rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    found = None
    for block in blocks(benchmark, settings):
        part = block_matches(docs, block, settings)
        found = part if found is None else found.unionByName(part)
    empty = "doc_id long, item_id long, edits int, item_words int, first_word int, end_word int"
    return found if found is not None else spark.createDataFrame([], empty)


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that have at most ``block_walks`` words together (or one item), one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        words = int(Words(pa.array([row["text"]], pa.string()), PUNCTUATION).counts[0])
        if not words:
            continue
        if block and size + words > settings.block_walks:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += words
    if block:
        yield block


def block_matches(docs: DataFrame, items: list[tuple[int, str]], settings: Settings) -> DataFrame:
    names = ["item_id", "edits", "item_words", "first_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = build(items, settings)
        for batch in batches:
            for part in pieces(batch):
                rows = list(search(part.column("text"), table, settings))
                if rows:
                    texts, ids, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(texts)), pa.array(ids, pa.int64()), *[pa.array(r, pa.int32()) for r in (rest[0], rest[1], rest[2], rest[3])]],
                        ["doc_id", *names],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits int, item_words int, first_word int, end_word int")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found, with all their columns; see ``contaminated``."""
    names, schema = docs.columns, docs.schema
    for block in blocks(benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            table = build(items, settings)
            for batch in batches:
                for part in pieces(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row[0] for row in search(part.column("text"), table, settings)]] = False
                    yield part.select(names).filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs

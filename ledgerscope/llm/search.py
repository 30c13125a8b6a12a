"""Ranked lexical search by norm buckets, in the manner of LEMP.

A document is the vector of its impacts, one coordinate for each term: what the
term adds to the score of an item that has it. An item is the vector of its
distinct terms, all ones, so a score is an inner product. Documents are ordered
by the length of their vectors and searched in buckets of similar length.

* By Cauchy-Schwarz no document of a bucket scores above the length of the item
  times the greatest length in the bucket; an item whose last rank is above that
  is done with the bucket. The sum of the greatest impacts of the item's terms
  in the bucket is another such bound.
* Inside a bucket the item's heaviest coordinates are added up first. What the
  others can add is bounded by the length that a vector has left without those,
  and by the greatest impacts; documents that cannot reach the last rank go.
* The rest are scored exactly in integers.

The longest vectors are searched first; the last ranks found there let the
tasks that search the others drop most of them. Only coordinates of terms that
some item has matter, so vectors are cut to those when they are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.blobs import pack, unpack
from ledgerscope.llm.tables import partitions
from ledgerscope.llm.tokens import hashed
from ledgerscope.llm.words import PUNCTUATION, U64
from ledgerscope.session import materialize

# Bounds are raised by this share, more than rounding can take away.
SLACK = 1 + 1e-9
RANKED = "item_row long, item_id long, doc_id long, row long, score long"


@dataclass(frozen=True)
class Settings:
    depth: int = 50
    # Documents in a bucket.
    bucket: int = 4096
    # Share of documents, the longest vectors, that is searched first.
    head: float = 1 / 32
    # Coordinates added up before the bound on the others is taken.
    focus: int = 8
    # Terms of items that are handed to the tasks at a time (8 bytes each); more items are searched in further passes.
    block_terms: int = 1 << 20


@dataclass(frozen=True)
class Items:
    """Items of one block; the terms of item i are ``terms[first[i]:first[i + 1]]``, places in ``vocabulary``."""

    rows: np.ndarray
    ids: list
    vocabulary: np.ndarray
    terms: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Corpus:
    """Numbers of documents and of terms, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What terms that occur ``counts`` times in documents of ``sizes`` terms add to a score."""
        m = 50 + (50 * sizes * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_row, item_id, terms, n_terms`` with the hashes of each item's distinct terms; items without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, first in hashed(batches, PUNCTUATION):
            sets = [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_row"), part.column("item_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                ["item_row", "item_id", "terms", "n_terms"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_row long, item_id long, terms binary, n_terms long").where("n_terms > 0")


def item_blocks(items: DataFrame, most: int) -> Iterator[Items]:
    """Items dealt out by hash into blocks of about ``most`` terms."""
    terms = materialize(item_terms(items), "item-terms")
    total = terms.agg(F.sum("n_terms")).first()[0] or 0
    blocks = -(-total // most)
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).orderBy("item_row").collect()
        if rows:
            sets = [np.frombuffer(r.terms, U64) for r in rows]
            vocabulary = np.unique(np.concatenate(sets))
            yield Items(
                rows=np.array([r.item_row for r in rows]),
                ids=[r.item_id for r in rows],
                vocabulary=vocabulary,
                terms=np.searchsorted(vocabulary, np.concatenate(sets)),
                first=np.concatenate([[0], np.cumsum([len(s) for s in sets])]),
            )


def cell(values: np.ndarray) -> bytes:
    return pack(values) if len(values) else bytes(4)


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``row, doc_id, size, terms, counts``: how often each document has the terms of the vocabulary; documents without any term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, first in hashed(batches, PUNCTUATION):
            sizes = np.diff(first)
            place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[place] == words)
            text = np.searchsorted(first, hit, side="right") - 1
            pairs, counts = np.unique(text * len(vocabulary) + place[hit], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(vocabulary))
            terms = (pairs % len(vocabulary)).astype(np.int32)
            counts = counts.astype(np.int32)
            spans = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
            made = pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([cell(np.diff(terms[s], prepend=np.int32(0))) for s in spans], pa.binary()),
                    pa.array([cell(counts[s]) for s in spans], pa.binary()),
                ],
                ["doc_id", "size", "terms", "counts"],
            )
            yield made.filter(pa.array(sizes > 0))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, terms binary, counts binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, term and count of all coordinates of a batch of ``term_counts``."""
    terms = [np.cumsum(unpack(x, np.int32), dtype=np.int64) for x in batch.column("terms").to_pylist()]
    counts = [unpack(x, np.int32) for x in batch.column("counts").to_pylist()]
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return rows, np.concatenate(terms), np.concatenate(counts).astype(np.int64)


def corpus_of(vectors: DataFrame, n_terms: int) -> Corpus | None:
    """Statistics of all documents; sums are formed in the tasks, so only the vocabulary's reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(n_terms, np.int64)
        for batch in batches:
            frequency += np.bincount(entries(batch)[1], minlength=n_terms)
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(frequency[held], pa.int64())], ["term", "documents"])

    totals = vectors.agg(F.count("*").alias("documents"), F.sum("size").alias("length")).first()
    if not totals.documents:
        return None
    held = vectors.select("terms", "counts").mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents")).toPandas()
    frequency = np.zeros(n_terms, np.int64)
    frequency[held["term"].to_numpy(np.int64)] = held["documents"].to_numpy(np.int64)
    weights = np.floor(1000 * np.log((2 * totals.documents + 2) / (2 * frequency + 1))).astype(np.int64)
    return Corpus(totals.documents, totals.length, weights)


def with_length(vectors: DataFrame, corpus: Corpus) -> DataFrame:
    """Add ``norm``, the length of the impact vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, counts = entries(batch)
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            impact = corpus.impacts(terms, counts, sizes[rows]).astype(np.float64)
            norm = np.sqrt(np.bincount(rows, impact * impact, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], [*batch.schema.names, "norm"])

    return vectors.mapInArrow(run, "doc_id long, size long, terms binary, counts binary, row long, norm double")


class Ranks:
    """The best documents of each item so far: score descending, then id (null last), then row."""

    def __init__(self, items: Items, least: np.ndarray, depth: int):
        self.depth = depth
        # A document must reach this to come in.
        self.least = np.maximum(least, 1)
        self.best = [np.zeros((4, 0), np.int64) for _ in items.ids]  # -score, id missing, id, row

    def add(self, item: int, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        all_ = np.concatenate([self.best[item], np.stack([-scores, missing, ids, rows])], axis=1)
        order = np.lexsort(all_[::-1])[: self.depth]
        self.best[item] = all_[:, order]
        if len(order) == self.depth:
            self.least[item] = max(self.least[item], -self.best[item][0, -1])


def search_bucket(items: Items, ranks: Ranks, settings: Settings, norms, rows, terms, impact, missing, ids, row_ids) -> None:
    """Put the documents of one bucket into the ranks; ``rows, terms, impact`` are its coordinates."""
    order = np.argsort(terms, kind="stable")
    rows, terms, impact = rows[order], terms[order], impact[order]
    low, high = np.searchsorted(terms, items.terms), np.searchsorted(terms, items.terms, side="right")
    there = high > low
    # The greatest impact of each term of an item in this bucket.
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    greatest = np.zeros(len(items.terms), np.int64)
    if len(starts):
        greatest[there] = np.maximum.reduceat(impact, starts)[np.searchsorted(starts, low[there])]
    of_item = items.first[:-1]
    caps = np.add.reduceat(greatest, of_item)
    lengths = np.sqrt(np.add.reduceat(there.astype(np.int64), of_item))
    reach = np.minimum(caps, lengths * norms.max() * SLACK)
    squares = norms * norms
    for item in np.flatnonzero((reach >= ranks.least) & (caps > 0)):
        a, b = items.first[item], items.first[item + 1]
        mine = a + np.argsort(-greatest[a:b], kind="stable")[: there[a:b].sum()]
        score = np.zeros(len(norms), np.int64)
        used = np.zeros(len(norms))
        focus, others = mine[: settings.focus], mine[settings.focus :]
        for t in focus:
            docs, add = rows[low[t] : high[t]], impact[low[t] : high[t]]
            score[docs] += add
            used[docs] += add.astype(np.float64) ** 2
        if len(others):
            # Rounding may leave a little less than was there.
            left = np.sqrt(np.maximum(squares * SLACK - used, 0) * len(others)) * SLACK
            bound = score + np.minimum(left, greatest[others].sum())
            if not (bound >= ranks.least[item]).any():
                continue
            for t in others:
                score[rows[low[t] : high[t]]] += impact[low[t] : high[t]]
        found = np.flatnonzero(score >= ranks.least[item])
        if len(found):
            ranks.add(item, score[found], missing[found], ids[found], row_ids[found])


def search(vectors: DataFrame, items: Items, corpus: Corpus, least: np.ndarray, settings: Settings) -> DataFrame:
    """For each task the best documents of each item that reach ``least``; vectors must come longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(items, least, settings.depth)
        for batch in batches:
            for start in range(0, batch.num_rows, settings.bucket):
                part = batch.slice(start, settings.bucket)
                rows, terms, counts = entries(part)
                sizes = part.column("size").to_numpy(zero_copy_only=False)
                ids = part.column("doc_id")
                search_bucket(
                    items,
                    ranks,
                    settings,
                    part.column("norm").to_numpy(zero_copy_only=False),
                    rows,
                    terms,
                    corpus.impacts(terms, counts, sizes[rows]),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                    ids.fill_null(0).to_numpy(zero_copy_only=False),
                    part.column("row").to_numpy(zero_copy_only=False),
                )
        for item, best in enumerate(ranks.best):
            n = best.shape[1]
            if n:
                columns = [
                    pa.array([int(items.rows[item])] * n, pa.int64()),
                    pa.array([items.ids[item]] * n, pa.int64()),
                    pa.array(best[2], pa.int64(), mask=best[1] > 0),
                    pa.array(best[3], pa.int64()),
                    pa.array(-best[0], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item_row", "item_id", "doc_id", "row", "score"])

    return vectors.select("doc_id", "size", "terms", "counts", "row", "norm").mapInArrow(run, RANKED)


def best_of(found: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def search_block(docs: DataFrame, items: Items, settings: Settings) -> DataFrame | None:
    vectors = materialize(term_counts(docs, items.vocabulary), "term-counts")
    corpus = corpus_of(vectors, len(items.vocabulary))
    if corpus is None:
        return None
    # Equal lengths, as copies have, are dealt out by row.
    measured = with_length(vectors, corpus).where("norm > 0")
    ordered = measured.repartitionByRange(partitions(docs.sparkSession), F.col("norm").desc(), "row").sortWithinPartitions(F.col("norm").desc())
    ordered = materialize(ordered, "by-length")
    bound = ordered.agg(F.percentile_approx("norm", 1 - settings.head)).first()[0]
    if bound is None:
        return None
    none = np.zeros(len(items.ids), np.int64)
    longest = ordered.where(F.col("norm") >= bound).sortWithinPartitions(F.col("norm").desc())
    head = materialize(best_of(search(longest, items, corpus, none, settings), settings.depth), "longest-first")
    last = {r.item_row: r.score for r in head.where(F.col("rank") == settings.depth).select("item_row", "score").collect()}
    least = np.array([last.get(int(row), 0) for row in items.rows], np.int64)
    shorter = ordered.where(F.col("norm") < bound).sortWithinPartitions(F.col("norm").desc())
    rest = search(shorter, items, corpus, least, settings)
    return best_of(head.drop("rank").unionByName(rest), settings.depth)


def ranked(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``depth`` highest-scoring documents of each item, all with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    A-Z in lower case, known by 64-bit hashes. Equal scores are ranked by
    ascending ``doc_id`` (null last), then by position. Null and empty texts
    have no terms; an item without terms has no rows, a repeated item has its
    rows each time, and repeated documents are ranked each. Empty tables give
    none; other columns are ignored. Items beyond ``block_terms`` terms are
    searched in further passes over the documents, so none is left out; of the
    documents only sums for the items' terms reach the driver.
    """
    found = None
    for block in item_blocks(items, settings.block_terms):
        part = search_block(docs, block, settings)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

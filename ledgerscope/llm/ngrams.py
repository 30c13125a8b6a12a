"""Language-model scores by deleted interpolation of word n-grams.

The probability of a word after another mixes the maximum-likelihood estimates
of the pair, of the word and of any word at all. The weights depend on how often
the context was seen (buckets by powers of two) and are learned by
expectation-maximisation on held-out counts: every training document is held
out in turn, its own counts deleted from the totals.

The documents are packed first: a pack holds the words of many documents as
numbers of its own vocabulary, and is written once. Counts travel as sorted
arrays of hashed n-grams, dealt out by ranges of the hash, so that a frequent
n-gram is one entry for each pack. Back to a pack go the totals alone, in the
order of its own n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.blobs import U64, pack, pack_sorted, unpack, unpack_sorted
from ledgerscope.llm.words import Words, mix, pieces, seeds
from ledgerscope.session import materialize

_PAIR = seeds(2, 21_000)
END, START = seeds(2, 22_000)
BUCKETS = 24
# Bins a decade and the number of bins of probabilities, by which held-out words are tallied.
FINENESS, BINS = 8, 128


@dataclass(frozen=True)
class Settings:
    """Words to a pack, keys to a range of hashes, and rounds of expectation-maximisation."""

    pack_words: int = 1_000_000
    range_keys: int = 400_000
    rounds: int = 60


def packs(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row for each pack: ``doc_ids, known, train, sizes, words, vocabulary`` as cells, and ``n_words``.

    ``docs`` has ``doc_id, text, train``. Each document ends with a word of its own kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def finish():
            nonlocal number, held, size
            ids, known, train, counts, hashes = (np.concatenate(x) for x in zip(*held))
            vocabulary, words = np.unique(hashes, return_inverse=True)
            cells = [pack(ids), pack(known), pack(train), pack(counts), pack(words.astype(np.int32)), pack_sorted(vocabulary)]
            row = [pa.array([number]), *[pa.array([c], pa.binary()) for c in cells], pa.array([len(hashes)])]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(row, NAMES)

        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"))
                n = words.texts
                hashes = np.insert(words.hashes, words.first[1:], END)
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                held.append((ids.cast(pa.int64()).fill_null(0).to_numpy(), known, train, (words.counts + 1).astype(np.int64), hashes))
                size += len(hashes)
                if size >= settings.pack_words and n:
                    yield finish()
        if held:
            yield finish()

    NAMES = ["pack", "doc_ids", "known", "train", "sizes", "words", "vocabulary", "n_words"]
    schema = "pack long, doc_ids binary, known binary, train binary, sizes binary, words binary, vocabulary binary, n_words long"
    return docs.select("doc_id", "text", "train").mapInArrow(run, schema)


class Pack:
    """A pack unfolded: ``word`` and ``pair`` number every word and every word with the one before it."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack(row["doc_ids"], np.int64), unpack(row["known"], np.uint8).astype(bool)
        self.train, self.sizes = unpack(row["train"], np.uint8).astype(bool), unpack(row["sizes"], np.int64)
        self.vocabulary, self.word = unpack_sorted(row["vocabulary"]), unpack(row["words"], np.int32)
        v = len(self.vocabulary)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.before = np.empty(len(self.word), np.int32)
        self.before[1:] = self.word[:-1]
        self.before[self.begins] = v  # the start of a document
        code, self.pair = np.unique(self.before.astype(np.int64) * (v + 1) + self.word, return_inverse=True)
        self.pair_before, pair_word = code // (v + 1), code % (v + 1)
        names = np.append(self.vocabulary, START)
        keys = mix(names[self.pair_before] * _PAIR[0] + self.vocabulary[pair_word] * _PAIR[1])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_keys, self.pair, self.pair_before = keys[order], place[self.pair], self.pair_before[order]
        self.in_training = np.repeat(self.train, self.sizes)

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair occurs at the chosen places."""
        words = np.bincount(self.word[chosen], minlength=len(self.vocabulary))
        return words, np.bincount(self.pair[chosen], minlength=len(self.pair_keys))

    def totals(self, table: pa.Table) -> list[np.ndarray]:
        """The counts of words and of pairs over all training documents, from the pack's rows of ``merged``."""
        out = []
        for kind in (0, 1):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind)).select(["range", "counts"]).to_pylist()
            out.append(np.concatenate([unpack(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["range"])]))
        return out


def counted(packed: DataFrame, bits: int) -> DataFrame:
    """``pack, kind, range, keys, counts``: the n-grams of every pack by ranges of their hash (kind 0: words, 1: pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
        for batch in batches:
            for row in batch.to_pylist():
                p = Pack(row)
                for kind, keys, counts in zip((0, 1), (p.vocabulary, p.pair_keys), p.counts(p.in_training)):
                    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    full = np.flatnonzero(cut[1:] > cut[:-1])
                    n = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, row["pack"])),
                            pa.array(np.full(n, kind, np.int32)),
                            pa.array(full),
                            pa.array([pack_sorted(keys[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                            pa.array([pack(counts[cut[i] : cut[i + 1]].astype(np.int64)) for i in full], pa.binary()),
                        ],
                        ["pack", "kind", "range", "keys", "counts"],
                    )

    return packed.mapInArrow(run, "pack long, kind int, range long, keys binary, counts binary")


def merged(counts: DataFrame) -> DataFrame:
    """``pack, kind, range, counts``: for each pack the totals of its n-grams, in their order.

    Rows without a pack tell, in ``distinct`` and ``total``, how many n-grams a
    range has and how often they occur.
    """

    def run(table: pa.Table) -> pa.Table:
        out = {n: [] for n in ("pack", "kind", "range", "counts", "distinct", "total")}
        number = table.column("range")[0].as_py()

        def add(*row):
            for values, value in zip(out.values(), row):
                values.append(value)

        for kind in (0, 1):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not rows.num_rows:
                continue
            packs_ = rows.column("pack").to_numpy()
            keys = [unpack_sorted(c.as_py()) for c in rows.column("keys")]
            own = [unpack(c.as_py(), np.int64) for c in rows.column("counts")]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(own), minlength=len(every)).astype(np.int64)
            at = 0
            for name, k in zip(packs_, keys):
                add(int(name), kind, number, pack(total[place[at : at + len(k)]]), 0, 0)
                at += len(k)
            add(None, kind, number, None, int(np.count_nonzero(total)), int(total.sum()))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return counts.groupBy("range").applyInArrow(run, "pack long, kind int, range long, counts binary, distinct long, total long")


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below the count."""
    return np.where(counts > 0, np.minimum(1 + np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1), 0)


def estimates(p: Pack, words: np.ndarray, pairs: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place of a pack: the bucket of its context and both maximum-likelihood estimates."""
    contexts = np.append(words, starts)[p.before]
    two = pairs[p.pair] / np.maximum(contexts, 1)
    return context_bucket(contexts), two, words[p.word] / max(total, 1)


def deleted_estimates(p: Pack, words: np.ndarray, pairs: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``estimates`` for training documents, each by the counts of all others."""
    document = np.repeat(np.arange(len(p.sizes)), p.sizes)

    def own(numbers: np.ndarray) -> np.ndarray:
        """How often the word or pair of each place occurs in its document."""
        _, place, counts = np.unique(document * (int(numbers.max()) + 1) + numbers, return_inverse=True, return_counts=True)
        return counts[place]

    own_words = own(p.word)
    own_contexts = np.empty_like(own_words)
    own_contexts[1:] = own_words[:-1]
    own_contexts[p.begins] = 1  # its start
    contexts = np.append(words, starts)[p.before] - own_contexts
    two = (pairs[p.pair] - own(p.pair)) / np.maximum(contexts, 1)
    one = (words[p.word] - own_words) / np.maximum(total - np.repeat(p.sizes, p.sizes), 1)
    return context_bucket(contexts), two, one


def held_out(packed: DataFrame, totals: DataFrame, starts: int, total: int) -> list:
    """All training words by context bucket and bins of both deleted estimates: rows of those three, a number and sums of estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "two", "one", "n", "sum_two", "sum_one"]
        tables = []
        for row in left.to_pylist():
            p = Pack(row)
            at = p.in_training
            if not at.any():
                continue
            # Places outside training documents are worked out and left out.
            bucket, two, one = (x[at] for x in deleted_estimates(p, *p.totals(right), starts, total))
            bins = [np.where(x > 0, np.clip(BINS + np.log10(np.maximum(x, 1e-300)) * FINENESS, 1, BINS).astype(np.int64), 0) for x in (two, one)]
            code, place = np.unique((bucket * (BINS + 1) + bins[0]) * (BINS + 1) + bins[1], return_inverse=True)
            sums = [np.bincount(place, w, minlength=len(code)).astype(float) for w in (np.ones(len(place)), two, one)]
            columns = [code // (BINS + 1) ** 2, code // (BINS + 1) % (BINS + 1), code % (BINS + 1), *sums]
            tables.append(pa.table([pa.array(c) for c in columns], names))
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in [pa.int64()] * 3 + [pa.float64()] * 3], names)

    tallies = (
        packed.groupBy("pack")
        .cogroup(totals.where(F.col("pack").isNotNull()).groupBy("pack"))
        .applyInArrow(run, "bucket long, two long, one long, n double, sum_two double, sum_one double")
    )
    # At most as many rows as there are buckets and bins, whatever the input.
    return tallies.groupBy("bucket", "two", "one").agg(F.sum("n"), F.sum("sum_two"), F.sum("sum_one")).orderBy("bucket", "two", "one").collect()


def learn_weights(rows: list, uniform: float, rounds: int) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each bucket, by expectation-maximisation.

    A bucket without held-out words takes the weights of the nearest lower one
    that has some; contexts never seen give the pair no weight.
    """
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    seen = np.zeros(BUCKETS, bool)
    for b in range(BUCKETS):
        mine = np.array([tuple(r)[3:] for r in rows if r["bucket"] == b], float).reshape(-1, 3)
        n = mine[:, 0]
        if not n.sum():
            continue
        p = np.stack([mine[:, 1] / n, mine[:, 2] / n, np.full(len(n), uniform)], 1)
        w = np.array([0.4, 0.5, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            parts = p * w
            shares = parts / parts.sum(1, keepdims=True)
            # One word of each kind is added, so that no estimate is ruled out.
            w = (shares * n[:, None]).sum(0) + (np.array([1.0, 1.0, 1.0]) if b else np.array([0.0, 1.0, 1.0]))
            w /= w.sum()
        weights[b], seen[b] = w, True
    for b in range(2, BUCKETS):
        if not seen[b] and (seen[1:b].any() or b > 2):
            weights[b] = weights[b - 1]
    return weights


def scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``doc_id, text, train``.

    Counts are learned from the rows where ``train`` is true (null: false), all
    of them. ``base_score`` is the text's log10 probability under smoothed word
    counts alone, ``score`` under the mixture. A null or empty text is one end
    of text. Without training rows every word is as likely as any other.
    Nothing depends on how the rows are dealt out, but for rounding.
    Repeated rows keep a row each; other columns are ignored.
    """
    packed = materialize(packs(docs.withColumn("train", F.coalesce("train", F.lit(False))), settings), "packs")
    n_words = packed.agg(F.sum("n_words")).first()[0] or 0
    bits = max(8, math.ceil(math.log2(max(1, n_words / settings.range_keys))))
    totals = materialize(merged(counted(packed, bits)), "ngram-counts")
    sums = totals.where(F.col("pack").isNull() & (F.col("kind") == 0)).agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = int(sums[0] or 0), int(sums[1] or 0)
    starts = docs.where("train").count()
    uniform = 1.0 / (distinct + 1)
    held = held_out(packed, totals, starts, total) if n_words else []
    weights = learn_weights(held, uniform, settings.rounds)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        tables = []
        for row in left.to_pylist():
            p = Pack(row)
            words, pairs = p.totals(right)
            bucket, two, one = estimates(p, words, pairs, starts, total)
            base = np.log10((words[p.word] + 0.5) / (total + 0.5 * (distinct + 1)))
            w = weights[bucket]
            score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform)
            known = (words[p.word] > 0).astype(np.int64)
            ids = pa.array(p.ids, mask=~p.known)
            by_text = [pa.array(np.add.reduceat(x, p.begins)) for x in (known, base, score)]
            n = len(p.ids)
            tables.append(pa.table([ids, pa.array(p.sizes), by_text[0], pa.array(np.full(n, total)), by_text[1], by_text[2]], names))
        types = [pa.int64()] * 4 + [pa.float64()] * 2
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in types], names)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("pack").cogroup(totals.where(F.col("pack").isNotNull()).groupBy("pack")).applyInArrow(run, schema)

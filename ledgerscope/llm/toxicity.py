"""Toxicity: cumulative-link ordinal regression of severity grades on the words of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.samples import bounded
from ledgerscope.llm.words import PUNCTUATION, Words, pieces

# Labelled documents of each label that are learned from.
MOST_PER_LABEL = 8000
GRADES = 3
MIN_DOCUMENTS = 4
MIN_ASSOCIATION = 4.0
STEPS, RIDGE = 400, 2e-4


def distinct_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each text and where those of each begin; case and punctuation do not count."""
    words = Words(texts, PUNCTUATION)
    owner = np.repeat(np.arange(words.texts), words.counts)
    order = np.lexsort((words.hashes, owner))
    h, o = words.hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[fresh], np.searchsorted(o[fresh], np.arange(words.texts + 1))


@dataclass(frozen=True)
class Severity:
    """Weights of words, shared by all grades, and the thresholds between grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, texts) -> np.ndarray:
        """The sum of the weights of the known distinct words of each text."""
        words = Words(texts, PUNCTUATION)
        out = np.zeros(words.texts)
        if not len(self.words):
            return out
        place = np.minimum(np.searchsorted(self.words, words.hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.words[place] == words.hashes)
        pairs = np.unique(np.stack([np.searchsorted(words.first, hit, side="right") - 1, place[hit]], 1), axis=0)
        np.add.at(out, pairs[:, 0], self.weights[pairs[:, 1]])
        return out

    def at_least(self, latent: np.ndarray) -> np.ndarray:
        """The probability of each grade or a higher one, from grade 1 on."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -500, 500)))


def grades(toxic: np.ndarray, signals: np.ndarray, most: int = GRADES) -> np.ndarray:
    """Severity from a 0/1 label: 0, else 1 to ``most`` by how many different signal words the text has."""
    return np.where(toxic, np.clip(signals, 1, most), 0).astype(int)


def fit(hashes: list[np.ndarray], toxic: np.ndarray, most: int = GRADES) -> Severity:
    """Learn from the distinct words of labelled texts.

    Words of too few texts, or hardly tied to the label, are left out. Severity
    is the label graded by the number of signal words, those nearly all of
    whose texts are toxic. One weight a word and ascending thresholds minimise
    the cumulative logit loss, each label weighing alike. Without texts of both
    labels nothing is known: every text gets the chance of the label seen.
    """
    unknown = np.zeros(0, np.uint64), np.zeros(0)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Severity(*unknown, np.full(most, -30.0 if len(toxic) and toxic.all() else 30.0))
    every = np.concatenate(hashes)
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    words, column = np.unique(every, return_inverse=True)
    n1, n0 = toxic.sum(), (~toxic).sum()
    k1 = np.bincount(column[toxic[row]], minlength=len(words))
    k0 = np.bincount(column[~toxic[row]], minlength=len(words))
    p = (k1 + k0) / (n1 + n0)
    z = (k1 / n1 - k0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    use = (k1 + k0 >= MIN_DOCUMENTS) & (np.abs(z) >= MIN_ASSOCIATION)
    odds = (k1 + 0.1) / n1 / ((k0 + 0.1) / n0)
    signal = use & (odds >= 20)
    new = np.cumsum(use) - 1
    mine = use[column]
    row, kept = row[mine], new[column[mine]]
    d, n = int(use.sum()), len(hashes)
    signals = np.bincount(row, signal[use][kept], minlength=n)
    y = grades(toxic, signals, most)
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    w, theta = np.zeros(d), np.linspace(0.5, 2.5, most)
    sums = [np.zeros(d), np.zeros(most)]
    grade = np.arange(1, most + 1)[None, :]
    for _ in range(STEPS):
        s = np.bincount(row, w[kept], minlength=n)
        edge = np.concatenate([np.full((n, 1), np.inf), s[:, None] - theta[None, :], np.full((n, 1), -np.inf)], 1)
        c = 1 / (1 + np.exp(-np.clip(edge, -500, 500)))
        here = np.maximum(c[np.arange(n), y] - c[np.arange(n), y + 1], 1e-12)
        slope = c * (1 - c)
        up, down = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        g = -weight * (up - down) / here
        gradient = np.bincount(kept, g[row], minlength=d) + RIDGE * w
        by_edge = weight[:, None] * ((grade == y[:, None]) * up[:, None] - (grade == y[:, None] + 1) * down[:, None]) / here[:, None]
        thresholds = by_edge.sum(0)
        for values, step, total in ((w, gradient, sums[0]), (theta, thresholds, sums[1])):
            total += step * step
            values -= 0.3 * step / np.sqrt(total + 1e-12)
        theta = np.maximum.accumulate(theta)
    order = np.argsort(words[use])
    return Severity(words[use][order], w[order], theta)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL) -> Severity:
    """Fit on at most ``most`` documents of each label of ``doc_id, toxic`` (values but 0 and 1 teach nothing).

    The ids are drawn first; they are few enough, by ``most``, to be handed to
    all tasks that read the texts. What is taken from this bounded sample is
    all that reaches the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    ids = bounded(known, "toxic", most).distinct()
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                h, first = distinct_words(part.column("text"))
                blobs = [h[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "x"])

    rows = chosen.mapInArrow(extract, "doc_id long, toxic int, x binary").toPandas().sort_values(["doc_id", "toxic", "x"])
    return fit([np.frombuffer(v, np.uint64) for v in rows["x"]], rows["toxic"].to_numpy() == 1)


def graded(docs: DataFrame, model: Severity) -> DataFrame:
    """``doc_id, expected_severity, grade, predicted, score`` for every row.

    The expected severity is the sum of the probabilities of grade 1 or more, 2
    or more and so on; ``score`` is the first of them, ``predicted`` is 1 where
    it reaches one half, and ``grade`` is the likeliest grade then, else 0. A
    null or empty text has no words. Repeated rows keep a row each; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                p = model.at_least(model.latent(part.column("text")))
                ends = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
                toxic = p[:, 0] >= 0.5
                grade = np.where(toxic, 1 + np.argmax((ends[:, :-1] - ends[:, 1:])[:, 1:], 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(toxic.astype(np.int32)), pa.array(p[:, 0])],
                    ["doc_id", "expected_severity", "grade", "predicted", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, predicted int, score double")

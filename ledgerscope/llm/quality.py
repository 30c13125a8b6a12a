"""Quality classifier: Bradley-Terry ranking of documents by preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.samples import bounded
from ledgerscope.llm.words import LOWER, PUNCTUATION, WHITESPACE, Words, pieces

# Labelled documents of each label that the ranking is learned from, and pairs drawn of them.
MOST_PER_LABEL = 6000
PAIRS = 100_000
THRESHOLD = 0.7
RIDGE = 1e-3
SHORT_LINE = 5

_CLASSES = [
    np.array([65 <= b < 91 for b in range(256)]),
    np.array([97 <= b < 123 for b in range(256)]),
    np.array([48 <= b < 58 for b in range(256)]),
    np.array([b >= 128 for b in range(256)]),
    WHITESPACE,
    np.array([b == 10 for b in range(256)]),
    PUNCTUATION & ~WHITESPACE,
    np.array([chr(b) in ".,;:" for b in range(256)]),
    np.array([chr(b) in "!?" for b in range(256)]),
    np.array([chr(b) in "|<>{}[]\\/=_" for b in range(256)]),
    np.array([chr(b) in "#$%&*@^~+" for b in range(256)]),
]
_CLASS_TABLE = np.stack(_CLASSES, 1).astype(np.float64)
N_FEATURES = 2 * (len(_CLASSES) + 8) + 1


def features(texts) -> np.ndarray:
    """A row of numbers for each text, from its bytes and words alone.

    Shares of kinds of bytes, length, length of words, shares of distinct,
    capital, one-letter and punctuated words and of words that follow
    themselves, each also as a square root. An empty text gives zeros but for
    the constant last column.
    """
    words = Words(texts)
    n = words.texts
    sizes = np.diff(words.offsets)
    counts = words.counts
    owner = np.repeat(np.arange(n), sizes)
    histogram = np.bincount(owner * 256 + words.buf, minlength=n * 256).reshape(n, 256)
    shares = histogram @ _CLASS_TABLE / np.maximum(sizes, 1)[:, None]
    word_owner = np.repeat(np.arange(n), counts)
    many = np.maximum(counts, 1)
    lengths = words.ends - words.starts
    per_text = lambda values: np.bincount(word_owner, values, minlength=n) / many
    distinct = np.zeros(n)
    if len(word_owner):
        order = np.lexsort((words.hashes, word_owner))
        h, o = words.hashes[order], word_owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[fresh], minlength=n) / many
        first, last = words.buf[words.starts], words.buf[words.ends - 1]
        capital = (first != LOWER[first]).astype(float)
        second = words.buf[np.minimum(words.starts + 1, len(words.buf) - 1)]
        shout = ((first != LOWER[first]) & (second != LOWER[second]) & (lengths > 1)).astype(float)
        closed = PUNCTUATION[last].astype(float)
        again = np.zeros(len(h))
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    else:
        capital = shout = closed = again = np.zeros(0)
    more = [
        np.log1p(counts) / 10,
        per_text(lengths.astype(float)) / 10,
        distinct,
        per_text(capital),
        per_text(shout),
        per_text((lengths == 1).astype(float)),
        per_text(closed),
        per_text(again),
    ]
    dense = np.column_stack([shares, *more])
    return np.column_stack([dense, np.sqrt(np.maximum(dense, 0)), np.ones(n)])


@dataclass(frozen=True)
class Ranking:
    """Weights of the ranking; ``cut`` is the latent score at the chosen quantile, ``scale`` its unit."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cut: float
    scale: float
    threshold: float = THRESHOLD

    def latent(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, equal to the threshold at the cut."""
        shift = np.log(self.threshold / (1 - self.threshold))
        z = np.clip((self.latent(x) - self.cut) / self.scale + shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD, seed: int = 7) -> Ranking:
    """Learn the ranking from labelled rows.

    Pairs of a good and a bad row are drawn with a seed; the logistic loss of
    the difference of their features is minimised by Newton's method with a
    small ridge. The cut is the quantile of the rows' scores at which fewest
    rows are on the wrong side (each label weighing alike). With one label, or
    none, every score is that label's side of the threshold (good if none).
    """
    d = x.shape[1] if x.ndim == 2 else N_FEATURES
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        side = -1.0 if not len(worse) else 1.0
        if not len(better) and not len(worse):
            side = -1.0
        return Ranking(np.zeros(d), np.zeros(d), np.ones(d), side, 1.0, threshold)
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(d)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = -diff.T @ p / pairs + RIDGE * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    latent = z @ w
    order = np.argsort(latent, kind="stable")
    ranked, is_bad = latent[order], ~good[order]
    # Rows before position k are rejected.
    wrong = np.concatenate([[0], np.cumsum(~is_bad)]) / len(better) + 1 - np.concatenate([[0], np.cumsum(is_bad)]) / len(worse)
    edges = np.concatenate([[ranked[0] - 1], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    # The middle of the widest run of equally good cuts, by score.
    cut = float((edges[best[0]] + edges[best[-1]]) / 2) if best[-1] - best[0] == len(best) - 1 else float(edges[best[len(best) // 2]])
    return Ranking(w, mean, spread, cut, float(max(latent.std(), 1e-9)), threshold)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL, threshold: float = THRESHOLD) -> Ranking:
    """Fit on at most ``most`` documents of each label of ``doc_id, quality`` (values but 0 and 1 teach nothing).

    The ids are drawn first; they are few enough, by ``most``, to be handed to
    all tasks that read the texts. What is taken from this bounded sample is
    all that reaches the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    ids = bounded(known, "quality", most).distinct()
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"]
                )

    rows = chosen.mapInArrow(extract, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "quality", "x"])
    x = np.stack([np.frombuffer(v) for v in rows["x"]]) if len(rows) else np.zeros((0, N_FEATURES))
    return fit(x, rows["quality"].to_numpy() == 1, threshold=threshold)


def scored(docs: DataFrame, ranking: Ranking, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` and ``predicted`` (1 from the threshold on).

    A null text counts as empty; an empty text is scored like any other.
    Repeated rows keep a row each. Other columns are neither read nor returned.
    """
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    with_text = keep if "text" in keep else [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                score = ranking.score(features(part.column("text")))
                predicted = (score >= ranking.threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(score), pa.array(predicted)], [*keep, "score", "predicted"])

    return docs.select(*with_text).mapInArrow(run, schema)




def kept(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                good = ranking.score(features(part.column("text"))) >= ranking.threshold
                yield part.select(names).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

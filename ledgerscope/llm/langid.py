"""Language identification: first the family, then a language within it.

Families are told apart by one machine against the rest each. Within a family
there is a machine for every two languages (one versus one); the language with
most of them on its side wins, among equals the one with the greatest margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.samples import bounded
from ledgerscope.llm.words import LOWER, PUNCTUATION, U64, pieces, seeds, text_buffer

# Families of common languages; a language missing here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he"],
    "indic": ["hi", "bn", "mr", "ne", "pa", "gu", "ur"],
    "iranian": ["fa", "ku"],
    "sinitic": ["zh"],
}
UNDETERMINED = "und"
DIMENSIONS = 1 << 12
MOST_PER_LANGUAGE = 800
STEPS, RIDGE = 120, 1e-4

_LETTER = (~PUNCTUATION) & ~np.array([48 <= b < 58 for b in range(256)])
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)
_GRAM = seeds(3, 501)


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three-byte runs of all texts and where those of each text begin.

    Letters are folded to lower case, all other characters to a space; each
    text is framed by spaces, so that beginnings and ends of words count.
    """
    buf, offsets = text_buffer(column)
    n = len(offsets) - 1
    framed = np.full(len(buf) + 2 * n, 32, np.uint8)
    at = np.arange(len(buf)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    framed[at] = _FOLD[buf]
    begin = offsets[:-1] + 2 * np.arange(n)
    code = framed[:-2].astype(U64) * _GRAM[0] + framed[1:-1].astype(U64) * _GRAM[1] + framed[2:].astype(U64) * _GRAM[2] if len(framed) > 2 else np.zeros(0, U64)
    blank = (framed[:-2] == 32) & (framed[1:-1] == 32) if len(framed) > 2 else np.zeros(0, bool)
    bucket = ((code ^ (code >> U64(29))) * U64(0x9E3779B97F4A7C15) >> U64(52)).astype(np.int64)
    # Runs of two blanks, also those across the border of two texts, all fall into bucket 0, which weighs nothing.
    bucket[blank] = 0
    last = begin[1:] - 2
    if len(bucket):
        bucket[last[(last >= 0) & (last < len(bucket))]] = 0
        second = begin[1:] - 1
        bucket[second[(second >= 0) & (second < len(bucket))]] = 0
    return bucket, begin


def has_letter(column) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    buf, offsets = text_buffer(column)
    sums = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in bytes(buf[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return found


def frequencies(column) -> np.ndarray:
    """Square roots of the shares of all buckets, a row for each text."""
    bucket, begin = grams(column)
    n = len(begin)
    owner = np.repeat(np.arange(n), np.diff(np.append(begin, len(bucket)))) if n else np.zeros(0, np.int64)
    counts = np.bincount(owner * DIMENSIONS + bucket, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)
    counts[:, 0] = 0
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def svm(x: np.ndarray, positive: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """A linear support vector machine (squared hinge, both sides weighing alike) by accelerated gradient steps."""
    n, d = x.shape
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    # Rows have length at most one, and a constant is added, so this is a safe step.
    rate = 1.0 / (2 * 2.0 + ridge)
    w = np.zeros(d + 1, np.float32)
    ahead = w.copy()
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * weight * slack * y
        gradient = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        gradient[:-1] += ridge * ahead[:-1]
        new = ahead - rate * gradient
        ahead = new + t / (t + 3.0) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Model:
    """Machines by family and, within each family, by pair of languages (in the order of ``pairs``)."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]] = field(default_factory=dict)
    language_weights: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        best = np.full(n, UNDETERMINED, object)
        score = np.zeros(n)
        if not self.families or not n:
            return best, score
        family, sure = _choose(x, self.family_weights)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(letters & (family == f))
            if len(rows):
                language, inner = _vote(x[rows], self.language_weights[name], len(self.languages[name]))
                best[rows] = np.array(self.languages[name], object)[language]
                score[rows] = sure[rows] * inner
        return best, score


def _choose(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class with the greatest margin, and the share its margin has of all (soft maximum)."""
    margin = x @ weights[:, :-1].T + weights[:, -1]
    e = np.exp(2.0 * (margin - margin.max(1, keepdims=True)))
    return margin.argmax(1), (1 / e.sum(1))


def pairs(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def _vote(x: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most pairs, ties by margins, and the share its mean margin has of all (soft maximum)."""
    votes, margins = np.zeros((len(x), n)), np.zeros((len(x), n))
    for (a, b), w in zip(pairs(n), weights):
        margin = x @ w[:-1] + w[-1]
        votes[:, a] += margin >= 0
        votes[:, b] += margin < 0
        margins[:, a] += margin / (n - 1)
        margins[:, b] -= margin / (n - 1)
    winning = np.where(votes == votes.max(1, keepdims=True), margins, -np.inf)
    best = winning.argmax(1)
    shares = np.exp(2.0 * (margins - margins.max(1, keepdims=True)))
    return best, shares[np.arange(len(x)), best] / shares.sum(1)


def fit(x: np.ndarray, languages: np.ndarray, families: dict[str, list[str]] | None = None) -> Model:
    """Learn one machine against the rest for every family, and one for every two languages of a family."""
    of = {lang: name for name, members in (families or FAMILIES).items() for lang in members}
    family = np.array([of.get(lang, f"={lang}") for lang in languages], object)
    names = sorted(set(family))
    machine = lambda rows, is_it: svm(x[rows], is_it) if not is_it.all() else np.zeros(DIMENSIONS + 1, np.float32)
    everything = np.arange(len(x))
    top = np.stack([machine(everything, family == f) for f in names]) if names else np.zeros((0, DIMENSIONS + 1), np.float32)
    members, inner = {}, {}
    for f in names:
        rows = np.flatnonzero(family == f)
        members[f] = sorted(set(languages[rows]))
        machines = []
        for a, b in pairs(len(members[f])):
            two = rows[np.isin(languages[rows], [members[f][a], members[f][b]])]
            machines.append(svm(x[two], languages[two] == members[f][a]))
        inner[f] = np.stack(machines) if machines else np.zeros((0, DIMENSIONS + 1), np.float32)
    return Model(names, top, members, inner)


def learn(labelled: DataFrame, most: int = MOST_PER_LANGUAGE, families: dict[str, list[str]] | None = None) -> Model:
    """Fit on at most ``most`` documents of each language of ``doc_id, text, lang``.

    Rows with a null id, text or language teach nothing. Only the features of
    this bounded sample reach the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # At most ``most`` ids a language: few enough to be handed to all tasks that read the texts.
    ids = bounded(known.select("doc_id", "lang"), "lang", most).distinct()
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                for i in range(0, part.num_rows, 256):
                    rows = part.slice(i, 256)
                    x = (frequencies(rows.column("text")) * 255 * 16).astype(np.uint16)
                    use = np.flatnonzero(has_letter(rows.column("text")))
                    taken = rows.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("lang"), pa.array([x[j].tobytes() for j in use], pa.binary())], ["doc_id", "lang", "x"])

    rows = chosen.mapInArrow(extract, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang", "x"])
    x = np.stack([np.frombuffer(v, np.uint16) for v in rows["x"]]).astype(np.float32) / (255 * 16) if len(rows) else np.zeros((0, DIMENSIONS), np.float32)
    return fit(x, rows["lang"].to_numpy(object), families)


def identified(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 where the text is null or has no letter, or if nothing
    was learned. Repeated rows keep a row each; other columns are ignored.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    with_text = keep if "text" in keep else [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                for i in range(0, part.num_rows, 256):
                    rows = part.slice(i, 256)
                    best, score = model.predict(frequencies(rows.column("text")), has_letter(rows.column("text")))
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*with_text).mapInArrow(run, schema)

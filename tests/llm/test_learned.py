"""Quality, toxicity, language and language-model scores: held-out accuracy and plain Python counts."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ledgerscope.llm import langid, ngrams, quality, samples, toxicity
from ledgerscope.llm.queries import QUERIES
from ledgerscope.llm.samples import bounded, split_number
from ledgerscope.llm.words import PUNCTUATION, Words

SF = "/root/testdata/sf0.01"


def test_words_and_shingles():
    texts = ["Hello the World\n x", None, "", " a", "é\x0bb c d e the World", "hello", "x y"]
    words = Words(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert words.counts.tolist() == [len(s) for s in split]
    names = {}
    for name, h in zip([w for s in split for w in s], words.hashes.tolist()):
        assert names.setdefault(name, h) == h
    assert len(set(names.values())) == len(names)
    sliced = Words(pa.array(["zz", *texts]).slice(1))
    assert sliced.hashes.tolist() == words.hashes.tolist()
    hashes, first = words.shingles(2)
    expected = [list(zip(s, s[1:])) if len(s) > 1 else [tuple(s)] if s else [] for s in split]
    assert np.diff(first).tolist() == [len(e) for e in expected]
    seen = {}
    for e, h in zip([x for s in expected for x in s], hashes.tolist()):
        assert seen.setdefault(e, h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.diff(words.shingles(5, short=False)[1]).tolist() == [max(0, len(s) - 4) for s in split]
    assert Words(pa.array(["don't stop-it, now!"]), PUNCTUATION).counts.tolist() == [5]
    assert Words(pa.array([], pa.string())).counts.tolist() == []


def test_bounded_samples(spark):
    rows = spark.createDataFrame([(i, i % 7 == 0) for i in range(500)], "doc_id long, label boolean")
    got = bounded(rows, "label", 20).groupBy("label").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(False, 20), (True, 20)]


def test_splits(spark):
    rows = spark.range(50).select(F.col("id"), split_number(F.col("id"), 5).alias("n")).collect()
    assert all(r.n == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_quality_on_held_out_documents(spark):
    rows = QUERIES["op6_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= 0.95


def test_ranking_orders_pairs_and_copes_with_one_label():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    good = x[:, 0] > 0.5
    ranking = quality.fit(x, good, pairs=5000)
    score = ranking.score(x)
    assert np.mean((score >= ranking.threshold) == good) > 0.97
    assert (quality.fit(x, np.ones(300, bool)).score(x) >= 0.7).all()
    assert (quality.fit(x, np.zeros(300, bool)).score(x) < 0.7).all()
    assert (quality.fit(np.zeros((0, 4)), np.zeros(0, bool)).score(x) >= 0.7).all()


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (8, 0), (5, 1), (99, 0), (None, 1), (3, None)], "doc_id long, quality int")
    ranking = quality.learn(odd, labels)
    rows = quality.scored(odd, ranking, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.kept(odd, ranking).columns == odd.columns
    assert quality.scored(odd.limit(0), ranking, ["doc_id"]).count() == 0


def test_toxicity_on_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == 1000
    found = [(rows[r.doc_id].predicted, r.toxic) for r in labels]
    assert np.mean([p for p, y in found if y]) > 0.7 and np.mean([p for p, y in found if not y]) < 0.02


def test_severity_grows_with_signal_words():
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = rng.sample(plain, 20) + (rng.sample(["nasty", "vile", "awful", "gross"], 1 + i % 4) if bad else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(bad)
    h, first = toxicity.distinct_words(pa.array(texts))
    model = toxicity.fit([h[a:b] for a, b in zip(first, first[1:])], np.array(toxic))
    assert (np.diff(model.thresholds) >= 0).all()
    one, two, three, none, empty = model.at_least(model.latent(pa.array(["so nasty", "NASTY, vile", "nasty vile gross", "word1 word2", None]))).sum(1)
    assert three > two > one > 0.5 > none and abs(none - empty) < 0.3
    for labels in (np.ones(3, bool), np.zeros(3, bool)):
        p = toxicity.fit([h[:2]] * 3, labels).at_least(np.zeros(1))
        assert (p > 0.99).all() if labels.all() else (p < 0.01).all()


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.graded(odd, toxicity.learn(odd, labels)).count() == odd.count()
    assert toxicity.graded(odd.limit(0), toxicity.learn(odd, labels.limit(0))).count() == 0


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op10_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd):
    model = langid.learn(odd)
    got = [(r.doc_id, r.lang_pred) for r in langid.identified(odd, model, ["doc_id"]).collect()]
    assert len(got) == odd.count()
    assert {i for i, p in got if p == "und"} == {1, 2, 3, 8, None}
    assert {r.lang_pred for r in langid.identified(odd, langid.learn(odd.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_hierarchy_separates_close_languages():
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi"], "ab": ["ka", "lo", "nu"], "zz": ["xq", "wy", "vv"]}
    texts = [(lang, " ".join("".join(rng.choices(p, k=3)) for _ in range(60))) for lang, p in parts.items() for _ in range(60)]
    x = langid.frequencies(pa.array([t for _, t in texts]))
    lang = np.array([n for n, _ in texts], object)
    use = np.arange(len(lang)) % 2 == 0
    model = langid.fit(x[use], lang[use], {"near": ["aa", "ab"]})
    assert model.families == ["=zz", "near"]
    assert (model.predict(x[~use], np.ones((~use).sum(), bool))[0] == lang[~use]).mean() == 1


def test_languages_of_a_family_are_told_apart_in_pairs():
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi"], "ab": ["ka", "lo", "nu"], "ac": ["ka", "mi", "nu"], "zz": ["xq", "wy", "vv"]}
    texts = [(lang, " ".join("".join(rng.choices(p, k=3)) for _ in range(60))) for lang, p in parts.items() for _ in range(60)]
    x = langid.frequencies(pa.array([t for _, t in texts]))
    lang = np.array([n for n, _ in texts], object)
    use = np.arange(len(lang)) % 2 == 0
    model = langid.fit(x[use], lang[use], {"near": ["aa", "ab", "ac"]})
    assert len(model.language_weights["near"]) == 3 and len(model.language_weights["=zz"]) == 0
    best, score = model.predict(x[~use], np.ones((~use).sum(), bool))
    assert (best == lang[~use]).mean() == 1 and ((score > 0) & (score <= 1)).all()
    # The votes are those of plain machines for two languages each.
    for (a, b), w in zip([("aa", "ab"), ("aa", "ac"), ("ab", "ac")], model.language_weights["near"]):
        two = use & np.isin(lang, [a, b])
        assert np.allclose(w, langid.svm(x[two], lang[two] == a))


def test_ties_of_votes_go_by_margin():
    # Each of three classes wins one pair; the second by far.
    weights = np.array([[0.0, 0.1], [0.0, -0.2], [0.0, 5.0]])
    best, score = langid._vote(np.zeros((2, 1)), weights, 3)
    assert best.tolist() == [1, 1] and (score > 0.9).all()
    best, score = langid._vote(np.zeros((1, 1)), np.zeros((0, 2)), 1)
    assert best.tolist() == [0] and score.tolist() == [1.0]


def test_model_scores_against_plain_counts(spark, docs, odd):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(names, k=rng.randrange(0, 40)))) for i in range(300)]
    data = docs(rows).unionByName(odd).withColumn("train", F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1)
    settings = ngrams.Settings(pack_words=700, range_keys=50)
    got = ngrams.scores(data, settings).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [None], r.train) for r in data.collect()]
    counts = collections.Counter(w for _, words, train in texts if train for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
        for i, w, _ in texts
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert ngrams.scores(data.limit(0), settings).count() == 0
    # How the text is dealt out and packed changes nothing but rounding.
    pairs = {(r.doc_id, r.n_tokens): r.score for r in ngrams.scores(data.repartition(7, F.rand(3))).collect()}
    assert max(abs(pairs[(r.doc_id, r.n_tokens)] - r.score) / abs(r.score) for r in got) < 1e-9


def plain_model(texts, rounds):
    """Scores by the same mixture, learned word by word: every training document is held out in turn."""
    train = [words for words, in_training in texts if in_training]
    words_of = collections.Counter(w for words in train for w in words)
    pairs_of = collections.Counter(p for words in train for p in zip(["^", *words], words))
    contexts_of = words_of + collections.Counter({"^": len(train)})
    total, uniform = sum(words_of.values()), 1 / (len(words_of) + 1)
    bucket = lambda n: 0 if n <= 0 else 1 + int(math.log2(n))
    seen = collections.defaultdict(list)
    for words in train:
        own_words, own_pairs = collections.Counter(words), collections.Counter(zip(["^", *words], words))
        for before, w in zip(["^", *words], words):
            context = contexts_of[before] - (1 if before == "^" else own_words[before])
            two = (pairs_of[before, w] - own_pairs[before, w]) / max(context, 1)
            seen[bucket(context)].append((two, (words_of[w] - own_words[w]) / (total - len(words)), uniform))
    weights = {}
    for b in range(1, 24):
        if b in seen:
            w = np.array([0.4, 0.5, 0.1])
            for _ in range(rounds):
                parts = np.array(seen[b]) * w
                w = (parts / parts.sum(1, keepdims=True)).sum(0) + 1
                w /= w.sum()
            weights[b] = w
        else:
            weights[b] = weights.get(b - 1, np.array([0.0, 0.9, 0.1]))
    def score(words):
        found = 0.0
        for before, w in zip(["^", *words], words):
            context = contexts_of[before]
            parts = pairs_of[before, w] / max(context, 1), words_of[w] / total, uniform
            found += math.log10(np.dot(weights[bucket(context)], parts))
        return found

    return [score(words) for words, _ in texts]


def test_mixture_against_word_by_word_learning(docs):
    rng = random.Random(8)
    rows = []
    for i in range(220):
        words = ["w0"]
        for _ in range(rng.randrange(5, 50)):
            # Half of the words follow from the one before.
            words.append(f"w{(int(words[-1][1:]) * 3 + 1) % 25}" if rng.random() < 0.5 else f"w{rng.randrange(25)}")
        rows.append((i, " ".join(words)))
    data = docs(rows).withColumn("train", F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.score for r in ngrams.scores(data, ngrams.Settings(pack_words=900)).collect()}
    expected = plain_model([([*t.split(), "$"], i % 4 != 0) for i, t in rows], ngrams.Settings().rounds)
    # Learning from tallies by bins instead of words moves scores a little.
    assert max(abs(got[i] - e) / abs(e) for (i, _), e in zip(rows, expected)) < 5e-3


def test_mixture_is_a_distribution_and_beats_single_words(spark):
    rows = QUERIES["op7_lm_scores"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)
    tallies = [dict(bucket=b, two=1, one=1, n=5.0, sum_two=2.5, sum_one=0.5) for b in (1, 4)]

    class Row(dict):
        def __iter__(self):
            return iter(self.values())

    weights = ngrams.learn_weights([Row(t) for t in tallies], 0.001, 50)
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0 and weights[4, 0] > 0.5


def test_pair_counts_over_packs(spark, docs):
    """The totals that a pack receives are the counts over all packs."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(60)]
    data = docs(rows).repartition(4).withColumn("train", F.col("doc_id") % 3 != 0)
    settings = ngrams.Settings(pack_words=200)
    packed = ngrams.packs(data, settings).cache()
    totals = ngrams.merged(ngrams.counted(packed, 3)).where("pack is not null").toArrow()
    expected = collections.Counter()
    for i, text in rows:
        if i % 3:
            words = ["^", *text.split(), "$"]
            expected.update(zip(words, words[1:]))
    found = []
    for row in packed.collect():
        p = ngrams.Pack(row.asDict())
        counts = p.totals(totals.filter(pa.compute.equal(totals.column("pack"), row.pack)))
        found += counts[1][p.pair].tolist()
    places = [expected[pair] for _, text in rows for pair in zip(["^", *text.split()], [*text.split(), "$"])]
    assert sorted(found) == sorted(places)


@pytest.mark.parametrize("bits", [3, 14])
def test_samples_are_the_first_by_hash(spark, monkeypatch, bits):
    """Against a sort of all rows: a frequent label, a rare one, a null one, and repeated rows at the edge."""
    monkeypatch.setattr(samples, "RANGE_BITS", bits)
    rows = [(i // 2, "often" if i % 50 else "rare") for i in range(3000)] + [(i, None) for i in range(40)] + [(None, "often")]
    table = spark.createDataFrame(rows, "doc_id long, label string").withColumn("_rank", F.lit("x")).drop("_rank")
    hashed = table.withColumn("h", F.xxhash64("doc_id")).collect()
    for most in (1, 25, 100, 5000):
        expected = []
        for label in ("often", "rare", None):
            own = sorted((r for r in hashed if r.label == label), key=lambda r: (r.h, r.doc_id is not None, r.doc_id))
            expected += [(r.doc_id, r.label) for r in own[:most]]
        got = [tuple(r) for r in samples.bounded(table, "label", most).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert samples.bounded(table.limit(0), "label", 5).count() == 0

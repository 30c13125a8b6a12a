"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from ledgerscope.llm import search as S

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, doc_id string, score long")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def every_score(docs, items, depth):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    found = []
    for item, text in items:
        scored = []
        for place, (doc, words) in enumerate(held):
            if not words:
                continue
            m, score = 50 + 50 * len(words) * n_docs // length, 0
            for term in set(terms(text)):
                if tf := words.count(term):
                    df = sum(term in t for _, t in held)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score:
                scored.append((-score, doc is None, doc or 0, place))
        found += [(item, k, None if none else doc, -s) for k, (s, none, doc, _) in enumerate(sorted(scored)[:depth], 1)]
    return sorted(found, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"Word{i}" if i % 3 else f"é{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60, 200]))) + rng.choice(["", "!", "\x7f", "_a"])) for i in range(n)]
    copies = [(n + i, docs[7][1]) for i in range(40)]
    queries = [(i, ", ".join(rng.sample(words, rng.choice([1, 2, 12, 30])))) for i in range(12)] + [(50, docs[7][1]), (51, docs[8][1])]
    return docs + copies, queries


@pytest.mark.parametrize("settings", [S.Settings(), S.Settings(depth=5, bucket=16, head=0.1, focus=2), S.Settings(depth=9, bucket=7, head=0.01, focus=1, block_terms=40)])
def test_ranks_are_those_of_scoring_everything(docs, items, settings):
    rows, queries = corpus(260, 4)
    got = S.ranked(docs(rows), items(queries), settings).collect()
    assert sorted(map(tuple, got), key=str) == every_score(rows, queries, settings.depth)


def test_most_documents_are_never_scored(monkeypatch):
    """Short vectors are dropped by their length, others by their heaviest coordinates."""
    rng = np.random.default_rng(1)
    items = S.Items(np.array([0]), [0], np.arange(20, dtype=np.uint64), np.arange(20), np.array([0, 20]))
    ranks = S.Ranks(items, np.array([10_000]), 5)
    scored = []
    monkeypatch.setattr(ranks, "add", lambda item, score, *rest: scored.append(len(score)))
    for size in (900, 2000, 5000):
        rows, terms = np.repeat(np.arange(64), 4), np.concatenate([np.sort(rng.choice(20, 4, replace=False)) for _ in range(64)])
        impact = np.full(256, size)
        norms = np.full(64, 2.0 * size)
        S.search_bucket(items, ranks, S.Settings(focus=4), norms, rows, terms, impact, np.zeros(64, int), np.arange(64), np.arange(64))
    assert scored == [64]


def test_ties_go_by_id_and_null_ids_come_last(docs, items):
    rows = [(9, "a b"), (3, "a b"), (None, "a b"), (5, "A,b"), (1, "c"), (2, None), (4, "")]
    got = S.ranked(docs(rows), items([(1, "a"), (1, "a"), (None, "a b"), (2, None), (3, "!!"), (4, "zzz")])).collect()
    for item, times in ((1, 2), (None, 1)):
        mine = sorted((r["rank"], -1 if r.doc_id is None else r.doc_id) for r in got if r.item_id == item)
        assert mine == sorted([(1, 3), (2, 5), (3, 9), (4, -1)] * times)
    assert {r.item_id for r in got} == {1, None}


def test_odd_rows_and_empty_tables(odd, items):
    got = S.ranked(odd, items([(1, "one w17 x É"), (2, "five")])).collect()
    assert {r.doc_id for r in got if r.item_id == 2} == {5, 6, None}
    assert 4 in {r.doc_id for r in got if r.item_id == 1}
    assert S.ranked(odd.limit(0), items([(1, "one")])).count() == 0
    assert S.ranked(odd, items([])).count() == 0
    assert S.ranked(odd.where("doc_id < 4"), items([(1, "one")])).count() == 0

"""Periodic runs against a search of every period at every place."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerscope.llm.periodic import Catchers, find_runs, periodic_runs
from ledgerscope.llm.queries import with_cycles
from ledgerscope.llm.tokens import word_hashes
from ledgerscope.llm.words import mix


def every_run(words, exponent):
    """Start, end and smallest period of all runs, by comparing each word with each earlier one."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        x = p
        while x < len(words):
            start = x
            while x < len(words) and words[x] == words[x - p]:
                x += 1
            if x - start + p >= exponent * p and x > start:
                found.setdefault((start - p, x), p)
            x += 1
    return sorted((s, e, p) for (s, e), p in found.items())


def numbers(words):
    return mix(np.array(words, np.uint64) + np.uint64(1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 5), st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_appended_words_give_all_runs(words, exponent, steps):
    catchers, at, i = Catchers(exponent, 4), 0, 0
    while at < len(words):
        step = steps[i % len(steps)]
        catchers.append(numbers(words[at : at + step]))
        at, i = at + step, i + 1
    assert sorted(map(tuple, catchers.finish().tolist())) == every_run(words, exponent)


def test_runs_end_with_their_text():
    texts = [[1] * 9, [1] * 3, [], [2, 1] * 6, [1, 2] * 6]
    first = np.cumsum([0] + [len(t) for t in texts])
    runs, at = find_runs(numbers(sum(texts, [])), first, 4)
    for i, text in enumerate(texts):
        assert [(s - first[i], e - first[i], p) for s, e, p in runs[at[i] : at[i + 1]].tolist()] == every_run(text, 4)


def test_repetitive_text_is_not_compared_pair_by_pair():
    words = np.concatenate([np.zeros(150_000, np.uint64), numbers(np.arange(150_000) % 999)])
    runs, _ = find_runs(words, np.array([0, len(words)]), 4)
    assert runs.tolist() == [[0, 150_000, 1], [150_000, 300_000, 999]]


def test_deceiving_sums_are_found_out():
    catchers = Catchers(2)
    catchers.append(numbers([1, 2, 3, 1, 2, 3, 1, 2, 9, 1, 2, 9]))
    runs = np.array([[0], [12], [3]])
    catchers._confirm(runs, 0)
    assert runs.T.tolist() == [[0, 8, 3]]


def test_long_texts_are_hashed_in_parts():
    texts = ["one two  three " * 50, "", "x" * 300 + " y\tz", None, "é 漢字 " * 40]
    whole, first = word_hashes(pa.array(texts))
    parts, firsts = word_hashes(pa.array(texts), limit=16)
    assert whole.tolist() == parts.tolist() and first.tolist() == firsts.tolist()


def collapsed(text):
    words = text.split()
    runs = [r for r in every_run(words, 4) if r[1] - r[0] >= 6]
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    return [(s, e - s, p) for s, e, p in runs], " ".join(w for i, w in enumerate(words) if i not in gone)


def test_words_after_the_first_period_are_dropped(docs):
    texts = ["a b " * 4 + "c", "A a A a A a A a", "go " * 5, "go " * 6 + "x " + "go " * 7, "x\n\ty  x y x y x y z z z z z z", "no run here"]
    got = {r.doc_id: r for r in periodic_runs(docs(list(enumerate(texts))), 4, 6).collect()}
    for i, text in enumerate(texts):
        assert ([tuple(r) for r in got[i].runs], got[i].collapsed) == collapsed(text)


def test_odd_rows(odd, docs):
    rows = periodic_runs(odd, 4, 6).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: (r.n_words, r.collapsed) for r in rows if r.doc_id in (1, 2, 3)} == {1: (0, ""), 2: (0, ""), 3: (0, "")}
    long = next(r for r in rows if r.doc_id == 4)
    assert [tuple(r) for r in long.runs] == [(0, 60_000, 5000)] and long.collapsed.count(" ") == 4999
    assert periodic_runs(odd.limit(0)).count() == 0


def test_one_text_in_ten_goes_in_a_cycle(docs, odd):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(200)]
    got = {r.doc_id: r.text for r in with_cycles(docs(rows)).collect()}
    for i, text in rows:
        words, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        assert (got[i] or "").split() == words
    assert with_cycles(odd).count() == odd.count()

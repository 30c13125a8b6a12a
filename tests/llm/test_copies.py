"""Near duplicates, repeated passages, benchmark items and the pipeline against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm import decontamination as D
from ledgerscope.llm import neardups as N
from ledgerscope.llm import passages as P
from ledgerscope.llm import tables
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def family_texts(seed, families=12, copies=9, length=(3, 120)):
    """Families of texts at growing distances, exact copies, and short texts."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    texts = []
    for _ in range(families):
        base = rng.choices(names, k=rng.randrange(*length))
        for c in range(copies):
            texts.append(" ".join(edited(rng, base, c * 0.02)))
        texts.append(" ".join(base).upper() + "  ")
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def expected_components(rows, n, percent=80):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "settings"), [(2, {}), (5, {"meetings_per_posting": 0, "star_rounds": 3}), (2, {"star_rounds": 1, "star_pairs": 1})])
def test_components_of_near_copies(docs, n, settings):
    rows = family_texts(n)
    got = N.near_duplicates(docs(rows), N.Settings(shingle=n, **settings)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected_components(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_in_which_only_the_base_is_near_all(docs):
    """Copies that differ from each other more than allowed still hang together through their base."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.045))) for i in range(1, 60)] + [(60, " ".join(base))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs(rows), N.Settings(shingle=2)).collect()}
    assert got == {i: c for i, (_, c) in expected_components(rows, 2).items()}


def test_a_large_group_without_links_is_not_held_pair_by_pair(docs, monkeypatch):
    """Copies with too many words of their own to be linked, without their base, meet hardly any other."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.07))) for i in range(1, 121)]
    met, counted = [], N.counted
    monkeypatch.setattr(N, "counted", lambda candidates, *rest: (met.append(candidates.distinct().count()), counted(candidates, *rest))[1])
    got = N.near_duplicates(docs(rows), N.Settings(shingle=2, equal_bits=120, meetings_per_posting=0)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected_components(rows, 2)
    assert sum(met) < 10 * len(rows)


def test_near_duplicates_of_odd_rows(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (5, 2, 5, True), (6, 2, 5, False), (None, 2, 5, False)} <= set(got)
    assert N.near_duplicates(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(docs, odd):
    rows = family_texts(7, families=5)
    kept = N.one_of_each(docs(rows), N.Settings(shingle=5))
    expected = {c for _, c in expected_components(rows, 5).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and kept.columns == docs(rows).columns
    ids = [r.doc_id for r in N.one_of_each(odd).collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 7, 8] and ids.count(None) == 2


def test_larger_id_lists_are_shuffled(docs, monkeypatch):
    monkeypatch.setattr(tables, "MOST_IDS", 0)
    rows = family_texts(8, families=4)
    got = N.near_duplicates(docs(rows), N.Settings(shingle=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected_components(rows, 2)


def test_compact_windows_cover_every_span_once():
    rng = np.random.default_rng(0)
    for _ in range(100):
        v = rng.integers(0, 8, rng.integers(0, 30)).astype(np.uint64)
        first, least = np.array([0, len(v) // 3, len(v)]), int(rng.integers(1, 6))
        cover = []
        for c, low, high in zip(*P.compact_windows(v, first, least)):
            assert v[low:high].min() == v[c]
            cover += [(i, j) for i in range(low, c + 1) for j in range(c, high) if j - i + 1 >= least]
        assert sorted(cover) == sorted((i, j) for a, b in zip(first, first[1:]) for i in range(a, b) for j in range(i + least - 1, b))


def planted(seed=4, count=60):
    """Texts of which some share passages of 55 to 120 words, exact or with few words replaced."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(55, 120))] for _ in range(8)]
    line = "please read this line in every text".split()
    rows, at = [], {}
    for i in range(count):
        words = [word() for _ in range(rng.randrange(20, 90))]
        if i % 2:
            k = rng.randrange(len(passages))
            body = edited(rng, passages[k], 0.02) if i % 5 == 0 and i > 30 else passages[k]
            at[i] = (k, len(words), len(words) + len(body))
            words += body
        words += [word() for _ in range(8)] + line + [word() for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words)))
    return rows, at


def test_planted_passages_are_found(docs):
    rows, at = planted()
    got = {}
    for r in P.repeats(docs(rows)).collect():
        assert r.source_doc_id < r.doc_id and r.end_word - r.first_word >= 50
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    first = {}
    for i, (k, low, high) in at.items():
        if k not in first:
            first[k] = i
            assert i not in got
        elif i % 5 or i < 30:
            assert any(a <= low and high <= b for a, b in got[i])
        else:
            assert sum(b - a for a, b in got[i]) >= 0.8 * (high - low)
    assert set(got) <= set(at)


def test_every_exact_repeat_is_found(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: r.text.encode().lower().split() for r in rows}
    covered = {}
    for r in QUERIES["op3_passages"](spark, SF).collect():
        covered.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    first = {}
    for i in sorted(words):
        w = words[i]
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(runs):
            if first.setdefault(run, i) != i:
                assert any(a <= k and k + 50 <= b for a, b in covered[i])


def test_cuts_leave_the_first_occurrence(docs, odd):
    rows, at = planted()
    got = {r.doc_id: r for r in P.without_repeats(docs(rows)).collect()}
    texts = dict(rows)
    first = {}
    for i, (k, low, high) in at.items():
        words = texts[i].split()
        if first.setdefault(k, i) == i:
            assert got[i].text == texts[i]
        elif i % 5 or i < 30:
            assert got[i].text.split() == words[:low] + words[high:] and got[i].n_chars == len(got[i].text)
    assert all(got[i].text == t for i, t in rows if i not in at)
    kept = P.without_repeats(odd)
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert P.without_repeats(odd.limit(0)).count() == 0


def test_a_copied_document_goes_and_repeats_inside_one_stay(docs):
    line = [f"r{i}" for i in range(30)]
    rows = [(1, " ".join(line * 9)), (2, " ".join(line * 9)), (3, " ".join(line * 4 + ["x"] * 3 + [f"q{i}" for i in range(70)]))]
    got = {r.doc_id: r.text for r in P.without_repeats(docs(rows)).collect()}
    assert got[1] == rows[0][1] and 2 not in got
    assert "q69" in got[3] and got[3].count("r1 ") < 4


def test_exact_repeats_in_a_family_of_versions_are_found(docs):
    """Many versions of a passage, each in two texts: every second text repeats the first one's version."""
    rng = random.Random(9)
    base = [f"p{i}" for i in range(60)]
    rows = []
    for v in range(60):
        body = edited(rng, base, 0.1)
        rows += [(k * 100 + v, [f"x{rng.randrange(10**6)}" for _ in range(20)] + body + [f"y{rng.randrange(10**6)}" for _ in range(20)]) for k in (0, 1)]
    got = P.repeats(docs([(i, " ".join(words)) for i, words in rows])).collect()
    whole = {r.doc_id for r in got if r.first_word <= 20 and r.end_word >= 80}
    assert whole >= {100 + v for v in range(60)}


def test_a_common_run_of_25_words_gives_a_common_key(docs):
    rng = random.Random(5)
    word = lambda: f"k{rng.randrange(10**6)}"
    rows = []
    for k in range(200):
        run = [word() for _ in range(25)]
        if k % 2:
            run[12:18] = run[2:8]
        rows += [(2 * k + side, " ".join([word() for _ in range(rng.randrange(40))] + run + [word() for _ in range(rng.randrange(40))])) for side in (0, 1)]
    got = P.windows(docs(rows).select(F.col("doc_id").alias("key"), "text"), P.Settings()).collect()
    keys = {}
    for r in got:
        keys.setdefault(r.key, set()).add(r.shingle)
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(200))


def test_passages_with_a_word_more_or_less_are_found(docs):
    """One word inserted or deleted anywhere in passages of 50 to 60 words."""
    rng = random.Random(8)
    rows = []
    for size in (50, 52, 55, 60):
        for k in range(size + 1):
            for more in (0, 1):
                body = [f"c{size}_{k}_{more}_{i}" for i in range(size + 1 - more)]
                copy = body[:k] + ["new"] + body[k:] if more else body[:k] + body[k + 1 :]
                for words in (body, copy):
                    around = [f"x{rng.randrange(10**6)}" for _ in range(40)]
                    rows.append((len(rows), " ".join(around[:20] + words + around[20:])))
    found = {r.doc_id for r in P.repeats(docs(rows)).collect()}
    assert found == set(range(1, len(rows), 2))


def levenshtein(a, b):
    cost = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(cost[j] + (x != y), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return cost[-1]


def test_edit_distance_to_the_best_run():
    rng = random.Random(1)
    for _ in range(150):
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64)
        window = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 14))], np.uint64)
        best = min(levenshtein(list(item), list(window[i:j])) for i in range(len(window) + 1) for j in range(i, len(window) + 1))
        edits, x, y = D.edit_distance(item, window, 99)
        assert edits == best == levenshtein(list(item), list(window[x:y]))


def items_and_texts(share, seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: f"t{rng.randrange(500)}"
    items = [(100 + i, " ".join(word() for _ in range(rng.randrange(14, 60)))) for i in range(n)]
    rows = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        for p in sorted(rng.sample(range(len(words)), int(share * len(words))), reverse=True):
            kind = rng.choice("sid")
            words[p : p + (kind != "i")] = [] if kind == "d" else [f"z{rng.randrange(99)}"]
        around = [word() for _ in range(80)]
        cut = rng.randrange(81)
        rows.append((k, " ".join(around[:cut]) + "\n" + ", ".join(words).upper() + "! " + " ".join(around[cut:])))
    return items, rows + [(k + n, " ".join(word() for _ in range(200))) for k in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.08, 0.15, 0.2])
def test_edited_items_are_found(spark, docs, share):
    items, rows = items_and_texts(share)
    benchmark = spark.createDataFrame([*items, (1, None), (2, ""), (3, "too short")], "item_id long, text string")
    settings = D.Settings(block_walks=1500) if share == 0.15 else D.Settings()
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(rows), benchmark, settings).collect()}
    planted = {(k, items[k][0]) for k in range(len(items))}
    assert len(planted & got) >= (1.0 if share < 0.1 else 0.95) * len(planted)
    words = lambda text: text.lower().replace(",", " ").replace("!", " ").split()
    for doc, item in got - planted:
        run, text = words(dict(items)[item]), words(dict(rows)[doc])
        assert min(levenshtein(run, text[i : i + len(run)]) for i in range(len(text))) <= 0.4 * len(run)


def short_items(sizes, edits, each=30, seed=6):
    """Items of the given sizes with so many edits (a function of the size), at even and odd words of a text each."""
    rng = random.Random(seed)
    items, rows = [], []
    for n in sizes:
        for _ in range(each):
            words = [f"s{rng.randrange(10**6)}" for _ in range(n)]
            items.append((len(items), " ".join(words)))
            for p in sorted(rng.sample(range(n), edits(n)), reverse=True):
                kind = rng.choice("sid")
                words[p : p + (kind != "i")] = [] if kind == "d" else ["z"]
            for before in (20, 21):
                rows.append((len(rows), " ".join([f"a{k}" for k in range(before)] + words + [f"b{k}" for k in range(20)])))
    return items, rows


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_items_of_1_to_13_words_are_found_at_even_and_odd_words(spark, docs, share):
    items, rows = short_items(range(1, 14), lambda n: int(share * n), each=8)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(docs(rows), benchmark).collect()}
    assert set(got) == {(k, k // 2) for k in range(len(rows))}
    assert all(e <= int(share * len(dict(items)[i].split())) for (_, i), e in got.items())


@pytest.mark.parametrize("size", [10, 15, 20, 24, 25, 30, 40])
def test_each_length_is_found_with_as_many_edits_as_allowed(size):
    settings = D.Settings()
    items, rows = short_items([size], lambda n: int(settings.max_edits * n), each=200)
    found = {(t, i) for t, i, *_ in D.search(pa.array([text for _, text in rows]), D.build(items, settings), settings)}
    assert len(found & {(k, k // 2) for k in range(len(rows))}) >= settings.target_recall * len(rows)


def test_clean_documents_stay(spark, docs, odd):
    items, rows = items_and_texts(0.05)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = D.clean(docs(rows), benchmark, D.Settings(block_walks=1500))
    assert sorted(r.doc_id for r in clean.collect()) == list(range(len(items), len(rows)))
    assert D.clean(odd, benchmark).count() == odd.count() and D.clean(odd, benchmark).columns == odd.columns
    assert D.contaminated(odd, benchmark.limit(0)).count() == 0 and D.contaminated(odd.limit(0), benchmark).count() == 0


def test_pipeline_stages_one_by_one(spark):
    """Each stage against what plain code says about its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages["quality"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    assert all((i in kept) == bool(q) for i, q in labels.items())
    one = stages["near duplicates"](spark, good, SF).cache()
    groups = expected_components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in groups.values()})
    cut = stages["repeated passages"](spark, one, SF).cache()
    seen = set()
    for r in cut.orderBy("doc_id").collect():
        words = r.text.encode().lower().split()
        runs = {tuple(words[k : k + 60]) for k in range(len(words) - 59)}
        assert not runs & seen
        seen |= runs
    clean = stages["decontamination"](spark, cut, SF).cache()
    plain = lambda text: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in cut.collect() if any(i in plain(r.text) for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert not dirty & left and len(left) >= 0.97 * (cut.count() - len(dirty))
    mix = stages["mixing"](spark, clean, SF)
    assert mix.columns == [*columns, "epoch"] and good.columns == one.columns == cut.columns == clean.columns == columns
    assert mix.agg(F.max("epoch")).first()[0] <= 3
    size = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(size(mix) / size(clean) - 1) < 0.1


def test_pipeline_survives_odd_and_empty_rows(spark, odd, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        path = str(tmp_path / name)
        rows.select(columns).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, path).columns == [*columns, "epoch"]


def test_windows_are_closed_by_one_look_at_the_passages_of_a_text(spark):
    """Windows inside one of many overlapping passages, held against every passage in turn."""
    settings = P.Settings(least_words=12)
    rng = random.Random(11)
    spans = [(k, b, b + rng.randrange(12, 60)) for k in (1, 2) for b in rng.sample(range(300), 60)]
    new = spark.createDataFrame([(k, 0, 0, b, e, b, e) for k, b, e in spans], "key long, version long, source long, first_word int, end_word int, source_word int, source_end int")
    reach = {r.key: r.reach for r in P.reaches(new).collect()}
    assert reach == {k: [max([e for x, b, e in spans if x == k and b <= at], default=0) for at in range(max(b for x, b, _ in spans if x == k) + 1)] for k in (1, 2)}
    windows = [(s, k, at, True, True) for s in range(3) for k in (0, 1, 2, 3) for at in range(0, 340, 3)]
    found = spark.createDataFrame(windows, "shingle long, key long, at int, open boolean, source boolean")
    sources = spark.createDataFrame([(s, 0, 0) for s in range(3)], "shingle long, source long, s_at int")
    inside = lambda k, at, margin: any(x == k and b <= at - margin and at + margin <= e - settings.shingle for x, b, e in spans)
    expected = {(s, k, at, not inside(k, at, 0), (k, at) > (0, 0) and not inside(k, at, settings.least - 1)) for s, k, at, _, _ in windows}
    expected = {row for row in expected if row[3] or row[4]}
    assert {tuple(r) for r in P.left_open(found, sources, new, settings).collect()} == expected

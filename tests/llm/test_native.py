"""Fingerprints, mixing and URL rules against plain Python."""

import base64
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from ledgerscope.llm import fingerprints as FP
from ledgerscope.llm import mixing as M
from ledgerscope.llm import urls as U
from ledgerscope.llm.tables import components, numbered


def test_row_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "a long, b long")
    rows = numbered(df, F.col("a").desc()).orderBy("row_number").collect()
    assert [(r.row_number, r.a) for r in rows] == [(i + 1, 100 - i) for i in range(101)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 3), (3, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 140)}, 7: 3, 3: 3}


def test_edits_follow_the_next_smaller_id(docs):
    texts = {9: "abcdefg", 4: "xy\nz", 2: "", 1: "\U0001f600ñ123456"}
    got = {r.doc_id: r for r in FP.edited_fingerprints(docs(list(texts.items()))).collect()}
    ids = sorted(texts, reverse=True)
    for i, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].n_chars == len(text)


def test_fingerprints_are_multiset_hashes(docs):
    rows = FP.fingerprints(docs([(1, "a\nb\nb"), (2, "b\na\nb"), (3, "a\nb"), (4, "a\nb\nb"), (5, "ab\nb")])).collect()
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[1] == by_id[2] == by_id[4]
    assert len({by_id[1], by_id[3], by_id[5]}) == 3


def test_likeness_is_that_of_the_printed_fingerprints(docs):
    rows = [(i, "\n".join(f"line {j} of {i // 2} with words" for j in range(3 + i % 4 * 5))) for i in range(12)] + [(12, "a\n\n"), (13, "\na\n"), (14, "")]
    got = FP.edited_fingerprints(docs(rows)).collect()

    def printed(text):
        values = np.frombuffer(base64.b64decode(text), ">u4").astype(int).tolist()
        runs = values[-1]
        return [2 * x - runs for x in values[FP.WIDE_LANES : -1]]

    def likeness(a, b):
        if a == b:
            return 1.0
        x, y = printed(a), printed(b)
        size = math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y))
        return max(0.0, sum(p * q for p, q in zip(x, y)) / size) if size else 0.0

    by_id = {r.doc_id: r for r in got}
    for r in got:
        after = by_id[r.doc_id - 1 if r.doc_id else 14]
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-5
        assert abs(r.near_next - likeness(r.fingerprint, after.fingerprint)) < 1e-5
    assert by_id[12].fingerprint == by_id[13].fingerprint and by_id[13].near_next == 1


def test_paragraphs_are_inserted_and_deleted(docs):
    parts = FP.lanes(docs([(1, "a\nb"), (2, "c"), (3, "a\nb\nc")]).select("doc_id", "text"), ["doc_id"], "text")
    a, b, c = (parts.where(f"doc_id = {i}").select(F.col("wide").alias(f"w{i}")) for i in (1, 2, 3))
    row = a.crossJoin(b).crossJoin(c).select(
        (FP.shift(F.col("w1"), F.col("w2")) == F.col("w3")).alias("inserted"), (FP.shift(F.col("w3"), F.col("w2"), -1) == F.col("w1")).alias("deleted")
    ).first()
    assert row.inserted and row.deleted


def test_likeness_follows_the_share_in_common(docs):
    words = [f"word{i} is here" for i in range(400)]
    rows = [(3, "\n".join(words)), (2, "\n".join(words[:200] + [w.upper() for w in words[:200]])), (1, "\n".join(w[::-1] for w in words))]
    got = {r.doc_id: r for r in FP.edited_fingerprints(docs(rows)).collect()}
    assert abs(got[3].near_next - 0.5) < 0.2 and got[2].near_next < 0.35
    assert 0.3 < got[3].near_edited < 1


def test_odd_rows_have_fingerprints(spark, odd):
    rows = FP.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.fingerprint for r in rows if r.n_chars == 27}
    assert len(same) == 1
    assert FP.edited_fingerprints(odd.limit(0)).count() == 0


def water_filling(sizes, weights, limit):
    """Targets by repeated sharing out."""
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        share = left
        for i in sorted(open_):
            target[i] += share * weights[i] / total
        left = 0.0
        for i in sorted(open_):
            if target[i] >= limit * sizes[i]:
                left += target[i] - limit * sizes[i]
                target[i] = limit * sizes[i]
                open_.discard(i)
    return target


def test_targets_are_shared_out_again(docs):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 7}" if i % 7 < 5 else "big") for i in range(400)] + [(900, "x y", "en", None)]
    got = M.mix(docs(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    expected = water_filling([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    target = {r.source: r.target for r in got}
    assert all(abs(target[s] - e) < 1e-6 for s, e in zip(names, expected))
    for s in names:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - target[s]) <= 5
    assert all(r.taken <= 3 * r["size"] for r in got)
    again = {(r.doc_id, r.taken) for r in M.mix(docs(rows)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_the_mix_repeats_documents(docs, odd):
    rows = [(i, "a b c", "en", "x" if i < 10 else "y") for i in range(100)]
    plan = {r.doc_id: r.copies for r in M.mix(docs(rows)).collect()}
    made = M.mixed(docs(rows))
    assert made.columns == [c for c in docs(rows).columns if c != "epoch"] + ["epoch"]
    counts = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}
    assert M.mix(odd).count() == odd.count() and M.mix(odd.limit(0)).count() == 0
    assert sum(r.taken for r in M.mix(odd).collect() if r["size"] == 0) == 0


URLS = {
    "https://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "HTTP://WWW.Example.com/en/x?q=http://y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/", "allow"),
    "http://x.com?u=/en/": ("x.com", "", None, "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://b.net/es/1#f": ("b.net", "/es/1", "net/es/", "block"),
    "http://b.net/de/1": ("b.net", "/de/1", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def test_longest_rule_wins(spark):
    urls = list(URLS)
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = U.judge(pages, rules, none).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[urls[r.page_id]]
    assert U.judge(pages.limit(0), rules, none).count() == 0


def test_mined_rules_block_what_is_bad(spark):
    """Pages about pills in a shop are bad; pills or shops alone are not."""
    rows = []
    for i in range(600):
        shop, pills = i % 2, i % 3 == 0
        rows.append((i, f"http://{'shop' if shop else 'news'}.org/{'pills' if pills else 'tea'}/{i}", bool(shop and pills)))
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 500] + [(None, True), (3, None)], "page_id long, bad boolean")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = {r.page_id: r.verdict for r in U.judge(pages, rules, labels).collect()}
    assert got == {r[0]: "block" if r[2] else "allow" for r in rows}
    parsed = U.with_parts(pages).withColumn("tokens", U.tokens())
    known = parsed.join(labels.where("page_id is not null and bad is not null"), "page_id")
    sets = [(set(r.tokens), r.bad) for r in known.collect()]
    share = sum(bad for _, bad in sets) / len(sets)
    rules = U.mined_rules(known.select("tokens", "bad")).collect()
    assert any(r.confidence == 1.0 for r in rules)
    for rule in rules:
        hold = [bad for tokens, bad in sets if tokens >= set(rule["items"])]
        assert abs(sum(hold) / len(hold) - rule.confidence) < 1e-9 and sum(hold) >= U.MIN_COUNT
        assert rule.confidence >= U.MIN_LIFT * share and rule.confidence >= share + U.MIN_ERRORS * (share * (1 - share) / len(hold)) ** 0.5


def test_deep_urls_and_labels_that_say_nothing(spark):
    """Frequent URLs of 40 and more tokens that are always seen together have one combination; chance decides nothing."""
    deep = "http://" + ".".join(f"l{i}" for i in range(12)) + "/" + "/".join(f"s{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"{deep}/x/{i}" if i % 3 else f"http://other.org/{i}", i % 3 == 1) for i in range(400)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad boolean").withColumn("tokens", F.lit(1))
    parsed = U.with_parts(pages).withColumn("tokens", U.tokens()).join(labels.select("page_id", "bad"), "page_id")
    found = U.mined_rules(parsed.select("tokens", "bad")).collect()
    assert len(found) == 1 and len(found[0]["items"]) >= 40 and abs(found[0].confidence - 0.5) < 0.01
    listed = spark.createDataFrame([], "rule string, verdict string")
    got = U.judge(pages, listed, labels).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 266, "allow": 134}
    even = spark.createDataFrame([(r[0], (r[0] // 3) % 2 == 0) for r in rows], "page_id long, bad boolean")
    assert U.mined_rules(parsed.drop("bad").join(even, "page_id").select("tokens", "bad")).count() == 0
    same = spark.createDataFrame([(r[0], True) for r in rows], "page_id long, bad boolean")
    assert {r.verdict for r in U.judge(pages, listed, same).collect()} == {"allow"}

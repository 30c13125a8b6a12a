"""Reply trees and chat formatting against plain Python, and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.chats import Template, chains, conversations, loss_text

MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double, node string, up string"
CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]


@pytest.fixture(scope="module")
def messages(spark):
    return lambda rows: spark.createDataFrame([(*r, "n", "u") for r in rows], MESSAGES)


def paths(rows):
    """All root-to-leaf paths as lists of rows, by walking up from each leaf."""
    by_id = {(r[0], r[1]): r for r in rows}
    answered = {(r[0], r[2]) for r in rows if (r[0], r[2]) in by_id and r[2] is not None}
    found = []
    for key in by_id.keys() - answered:
        path, row = [], by_id[key]
        while row is not None and len(path) <= len(rows):
            path.append(row)
            row = by_id.get((row[0], row[2])) if row[2] is not None else None
        if len(path) <= len(rows):
            found.append(path[::-1])
    return found


def test_branches_of_random_trees(messages):
    rng = random.Random(5)
    rows = []
    for tree in range(6):
        for m in range(40):
            parent = rng.choice([None, rng.randrange(m) if m else None, m - 1 if m else None, 99])
            rows.append((tree, m, parent, rng.choice(["user", "assistant", "system"]), f"t{tree} m{m} \\<s>", float(rng.randrange(4))))
    got = conversations(messages(rows)).collect()
    expected = {}
    for path in paths(rows):
        score = round(sum(r[5] for r in path) / len(path), 9)
        expected[path[0][0], path[-1][1]] = score, [(r[3], r[4]) for r in path]
    assert {(r.tree_id, r.leaf_id): (r.score, r.n_turns) for r in got} == {k: (s, len(t)) for k, (s, t) in expected.items()}
    for tree in range(6):
        ranked = sorted((r for r in got if r.tree_id == tree), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
        assert [r.leaf_id for r in ranked] == sorted((l for t, l in expected if t == tree), key=lambda l: (-expected[tree, l][0], l))
    turns = conversations(messages(rows)).select("tree_id", "leaf_id", Template().turns(F.col("formatted")).alias("turns")).collect()
    assert {(r.tree_id, r.leaf_id): [(t.role, t.text) for t in r.turns] for r in turns} == {k: t for k, (_, t) in expected.items()}
    best = conversations(messages(rows), keep=2).collect()
    assert {(r.tree_id, r.leaf_id) for r in best} == {(r.tree_id, r.leaf_id) for r in got if r["rank"] <= 2}


def test_long_chains_and_circles(messages):
    chain = [(1, i, i - 1 if i else None, "user", f"{i}", None) for i in range(70)]
    circle = [(2, 1, 3, "user", "a", 1.0), (2, 2, 1, "user", "b", 1.0), (2, 3, 2, "user", "c", 1.0), (2, 4, 1, "user", "tail", 1.0), (2, 9, None, "user", "root", 1.0), (2, 8, 8, "user", "self", 1.0)]
    got = conversations(messages(chain + circle)).collect()
    assert sorted((r.tree_id, r.leaf_id, r.n_turns) for r in got) == [(1, 69, 70), (2, 9, 1)]


def test_control_strings_are_escaped_reversibly(spark, messages):
    texts = CONTROLS + ["".join(CONTROLS), "\\", "\\\\<s>\\", "<\\s>", "[INST[INST]", "<<s>", "<", "[/", "a\n$1\\n", "é\U0001f600<s>", "<|im_<|im_end|>end|>", None, ""]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["<", "s>", "/s>", "[", "INST]", "\\", "|im_end|>", "x"]) for _ in range(8)) for _ in range(200)]
    rows = [(i, 0, None, t, t, 0.0) for i, t in enumerate(texts)]
    template = Template()
    made = conversations(messages(rows), template)
    for r in made.select("tree_id", "formatted", "segments", template.turns(F.col("formatted")).alias("turns")).collect():
        text = texts[r.tree_id] or ""
        assert [(t.role, t.text) for t in r.turns] == [(text, text)]
        assert all(c not in s for c in CONTROLS for s in (r.segments[1].text, r.segments[0].text[len("<|im_start|>") : -len("<|im_sep|>")]))
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_sep|>") == r.formatted.count("<|im_end|>") == 1
        assert "".join(s.text for s in r.segments) == r.formatted


def test_only_answers_are_learned(messages):
    rows = [(1, 0, None, "system", "s", 0.0), (1, 1, 0, "assistant", "<s>one", 0.0), (1, 2, 1, "assistant", "two", 0.0), (1, 3, 2, None, "three", 0.0)]
    row = conversations(messages(rows)).select(loss_text(F.col("segments")).alias("learned"), "segments").first()
    assert row.learned == "<s>onetwo"
    assert [s.text for s in row.segments if s.loss] == ["<\\s>one", "two"]


def test_odd_rows(spark, messages):
    rows = [(None, None, None, None, None, None), (None, 1, None, "user", "x", None), (1, None, None, "user", "y", 1.0), (1, 1, None, "user", "z" * 200_000, 1.0)]
    rows += [(2, 1, None, "user", "b", 0.0), (2, 1, None, "user", "a", 0.0), (2, 1, None, "user", "a", 0.0)]
    got = {(r.tree_id, r.leaf_id): r for r in conversations(messages(rows)).collect()}
    assert set(got) == {(None, None), (None, 1), (1, None), (1, 1), (2, 1)}
    assert got[2, 1].segments[1].text == "a" and got[None, None].formatted == "<|im_start|><|im_sep|><|im_end|>"
    assert conversations(messages([])).count() == 0
    plain = spark.createDataFrame([(7, 1, "user", "b"), (7, 1, "user", "b"), (7, None, None, None), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert {(r.tree_id, r.n_turns) for r in conversations(chains(plain)).collect()} == {(7, 3), (None, 1)}


def test_marks_must_be_apart():
    with pytest.raises(ValueError):
        Template(opening="<a", middle="b<a>", closing="<c>")

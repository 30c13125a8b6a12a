"""Chat formatting of reply trees, with DataFrame functions only.

Messages that answer each other form trees; every path from a root to a leaf is
a branch. Branches are enumerated from their leaves upwards by iterative
self-joins: the first gives each message's parent, each further one the ancestor
twice as far up, so a path of n messages takes log n joins. Then a branch is
spelled out by going up 2^k messages for each k, largest first, or staying, so
that every message on it is met once. Branches of a tree are ranked by the mean
score of their messages, and each one chosen is written as one conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.tables import numbered
from ledgerscope.session import materialize


@dataclass(frozen=True)
class Template:
    """A turn is ``opening role middle text closing``.

    These and all of ``reserved`` are control strings. Within roles and texts a
    backslash stands behind the first character of each control string, and
    backslashes are doubled; dropping one backslash before every character
    gives the text back.
    """

    opening: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_role: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return [self.opening, self.middle, self.closing, *self.reserved]

    def __post_init__(self):
        marks = {self.opening, self.middle, self.closing}
        if len(marks) < 3 or any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings are different, have two characters at least and no backslash")
        if any(m[0] in c[1:] for m in marks for c in marks):
            raise ValueError("no mark may begin inside another")

    def escape(self, text: Column) -> Column:
        found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(found), F.lit(r"$0\\"))

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))

    def segments(self, turns: Column) -> Column:
        """Stretches ``text, loss`` of the formatted conversation, for an array of ``role, text``."""

        def of_turn(turn: Column) -> Column:
            parts = [
                (F.concat(F.lit(self.opening), self.escape(turn["role"]), F.lit(self.middle)), F.lit(False)),
                (self.escape(turn["text"]), turn["role"] == self.loss_role),
                (F.lit(self.closing), F.lit(False)),
            ]
            return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])

        return F.flatten(F.transform(turns, of_turn))

    def turns(self, formatted: Column) -> Column:
        """The array of ``role, text`` that a formatted conversation was made of."""
        pieces = F.split(formatted, re.escape(self.closing), -1)
        halves = lambda piece: F.split(piece, re.escape(self.middle), 2)
        return F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            lambda p: F.struct(
                self.unescape(F.substr(halves(p)[0], F.lit(len(self.opening) + 1))).alias("role"), self.unescape(halves(p)[1]).alias("text")
            ),
        )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: Template.unescape(s["text"])), "")


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``node, up`` of the ancestors 1, 2, 4, ... messages up, and the nodes that never reach a root.

    ``nodes`` has ``node, up`` (null for roots). Parents that answer each other
    in a circle go on for ever; they are known by having ancestors farther up
    than there are messages.
    """
    most = nodes.count()
    levels, step = [], 1
    level = nodes.where("up IS NOT NULL").select("node", "up")
    while step <= most and not level.isEmpty():
        levels.append(level)
        farther = level.select(F.col("node").alias("up"), F.col("up").alias("farther"))
        level = materialize(level.join(farther, "up").select("node", F.col("farther").alias("up")), "ancestors")
        step *= 2
    return levels, level.select("node")


def branches(nodes: DataFrame) -> DataFrame:
    """``leaf, node, distance`` for every message on the way from each leaf to its root."""
    levels, lost = ancestors(nodes)
    answered = nodes.select(F.col("up").alias("node")).where("node IS NOT NULL").distinct()
    leaves = nodes.join(answered, "node", "left_anti").join(lost, "node", "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k, level in reversed(list(enumerate(levels))):
        here = F.struct("node", "distance")
        there = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance")))
        both = F.filter(F.array(here, there), lambda x: x.isNotNull())
        paths = paths.join(level, "node", "left").select("leaf", F.inline(both))
    return paths


def conversations(messages: DataFrame, template: Template = Template(), keep: int | None = None) -> DataFrame:
    """One formatted conversation for each branch of each tree, or the ``keep`` best ones of a tree.

    ``messages`` has ``tree_id, message_id, parent_id, role, text, score``; a
    message without a parent, or whose parent is not in its tree, is a root.
    Branches are ranked by the mean score of their messages (rounded to nine
    decimals), then by the id of their leaf. Null roles and texts count as empty, null scores
    as 0; null tree and message ids are ids of their own. Of rows with the same
    tree and message id the least stays. Messages whose parents form a circle
    are on no branch. A table without rows gives none; other columns are
    ignored.

    Returns ``tree_id, leaf_id, rank, score, n_turns, formatted, segments``;
    ``segments`` are the stretches of ``formatted`` in order, with ``loss`` where
    a text is to be learned. A branch is put together in one task, as it is one
    row; all else is dealt out by message. Ranks come from ranges, so a tree
    with very many branches is not sorted in one task.
    """
    # JSON leaves out nulls, so that a null id differs from all others.
    node = lambda message: F.to_json(F.struct(F.col("tree_id").alias("t"), F.col(message).alias("m")))
    row = F.struct(
        "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).cast("double").alias("score")
    )
    kept = materialize(
        messages.groupBy("tree_id", "message_id").agg(F.min(row).alias("m")).select("tree_id", "message_id", node("message_id").alias("node"), "m.*"), "messages"
    )
    parents = kept.where("parent_id IS NOT NULL").select("node", node("parent_id").alias("up"))
    there = kept.select(F.col("node").alias("up"))
    links = parents.join(there, "up", "left_semi").select("node", "up")
    nodes = materialize(kept.select("node").join(links, "node", "left"), "nodes")
    paths = materialize(branches(nodes), "branches")

    scores = paths.join(kept.select("node", "score"), "node").groupBy("leaf").agg(F.round(F.avg("score"), 9).alias("score"))
    ids = kept.select(F.col("node").alias("leaf"), "tree_id", F.col("message_id").alias("leaf_id"))
    order = [F.col("tree_id"), F.col("score").desc(), F.col("leaf_id")]
    ranked = materialize(numbered(scores.join(ids, "leaf"), *order, name="place"), "ranks")
    first = ranked.groupBy(F.to_json(F.struct("tree_id")).alias("tree")).agg(F.min("place").alias("first"))
    chosen = (
        ranked.withColumn("tree", F.to_json(F.struct("tree_id")))
        .join(first, "tree")
        .withColumn("rank", F.col("place") - F.col("first") + 1)
        .select("leaf", "tree_id", "leaf_id", "rank", "score")
    )
    if keep is not None:
        chosen = chosen.where(F.col("rank") <= keep)
    turns = paths.join(kept.select("node", "role", "text"), "node").select("leaf", F.struct((-F.col("distance")).alias("place"), "role", "text").alias("turn"))
    spelled = turns.groupBy("leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    made = chosen.join(spelled, "leaf").withColumn("segments", template.segments(F.col("turns")))
    return made.select(
        "tree_id",
        "leaf_id",
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
    )


def chains(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (``conv_id, turn, role, text``): each turn answers the one before; ties by role, then text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return turns.select("conv_id", "turn", "role", "text").withColumn("message_id", place.cast("long")).select(
        F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )

"""Shortest directed paths and circular flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.session import materialize

# How paths between the same two nodes are compared: see ``collapse_pairs``.
BY_ADDRESS = "address"
BY_TIME = "time"


# For at most this many requests only the edges in their reach are collapsed.
FEW_REQUESTS = 1000


@dataclass(frozen=True)
class PairGraph:
    """Collapsed edges and how many neighbours each node has: ``node, fan_out, fan_in``."""

    pairs: DataFrame
    fans: DataFrame


def collapse_pairs(edges: DataFrame, order: str = BY_ADDRESS) -> PairGraph:
    """One row per (src, dst), and how many neighbours each end has.

    A shortest path never repeats a node, so parallel edges only decide which hash
    is reported, which ``with_hashes`` looks up for the paths that were found.
    ``times`` ranks paths: empty to compare them by their addresses alone; with the
    edge's first time to prefer the path that was complete first.
    """
    ends = [F.col("from_address").alias("src"), F.col("to_address").alias("dst")]
    if order == BY_TIME:
        first = edges.groupBy(*ends).agg(F.min("timestamp").alias("since"))
        pairs = first.select("src", "dst", F.array("since").alias("times"))
    else:
        pairs = edges.select(*ends).distinct().withColumn("times", F.array().cast("array<timestamp>"))
    pairs = materialize(pairs, "pairs")
    sides = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("leaves")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("leaves"))
    )
    fans = pairs.select(F.inline(sides)).groupBy("node").agg(
        F.sum("leaves").alias("fan_out"), (F.count("*") - F.sum("leaves")).alias("fan_in")
    )
    return PairGraph(pairs=pairs, fans=materialize(fans, "fans"))


def edges_in_reach(edges: DataFrame, requests: DataFrame, hops: int) -> DataFrame:
    """The edges that a walk of at most ``hops`` (up to 4) steps from a ``src`` to a ``dst`` can use.

    First steps leave a source and last steps enter a target; steps between start
    where first ones end or end where last ones start. For few requests against a
    long history these are a few semi joins instead of an aggregation of all edges.
    """
    first = edges.join(requests.select(F.col("src").alias("from_address")).distinct(), "from_address", "left_semi")
    last = edges.join(requests.select(F.col("dst").alias("to_address")).distinct(), "to_address", "left_semi")
    if hops == 1:
        return first.join(requests.select(F.col("dst").alias("to_address")).distinct(), "to_address", "left_semi")
    reach = first.unionByName(last)
    if hops == 2:
        return reach
    after = first.select(F.col("to_address").alias("from_address")).distinct()
    before = last.select(F.col("from_address").alias("to_address")).distinct()
    second = edges.join(after, "from_address", "left_semi")
    # The same edge may qualify more than once; collapsing to pairs removes that.
    if hops == 3:
        return reach.unionByName(second.join(before, "to_address", "left_semi"))
    return reach.unionByName(second).unionByName(edges.join(before, "to_address", "left_semi"))


def _latest_first(a: Column, b: Column) -> Column:
    return F.sort_array(F.concat(a, b), asc=False)


class WalkSearch:
    """For each (src, dst) the best walk of one pair, then two, then three and so on: columns times, path.

    Walks are compared by ``times`` (latest edge first), then by path. Both orders
    survive adding the same pair to two walks, so keeping the best one per state
    is enough and no list of walks is ever built. Each request is opened at the end
    with fewer neighbours, which gives requests between inner nodes: a hub at
    one end costs what the other end costs, and the total stays near the sum over
    requests of the smaller degree.

    What was opened for one count is kept: the next count opens only the inner
    requests made last, looks their pairs up, and carries the walks found back
    to the outer requests level by level.
    """

    def __init__(self, graph: PairGraph, most: int):
        self.graph = graph
        self.most = most
        self.hops = 0
        # Per level: request, the inner request it leads to, the pair between them.
        self.links: list[DataFrame] = []

    def next(self, still_open: DataFrame) -> DataFrame:
        """Walks with one more pair than before, for the requests still open at least."""
        self.hops += 1
        single = self.graph.pairs.select("src", "dst", "times", F.array("src", "dst").alias("path"))
        if self.hops == 1:
            return single
        level = still_open
        for links in self.links:
            level = links.join(level, ["src", "dst"], "left_semi").select(F.col("inner.src"), F.col("inner.dst")).distinct()
        opened = self._open(level)
        # What is opened last is read only once.
        self.links.append(materialize(opened, f"opened{self.hops}") if self.hops < self.most else opened)
        walks = single
        for links in reversed(self.links):
            walks = self._carry_back(links, walks)
        return walks

    def _open(self, level: DataFrame) -> DataFrame:
        pairs, fans = self.graph.pairs, self.graph.fans
        sized = level.join(fans.select(F.col("node").alias("src"), "fan_out"), "src").join(
            fans.select(F.col("node").alias("dst"), "fan_in"), "dst"
        )
        first = pairs.select("src", F.col("dst").alias("mid"), F.col("times").alias("step"))
        last = pairs.select(F.col("src").alias("mid"), "dst", F.col("times").alias("step"))
        ahead = sized.filter("fan_out <= fan_in").join(first, "src")
        behind = sized.filter("fan_out > fan_in").join(last, "dst")
        return ahead.select("src", "dst", F.struct(F.col("mid").alias("src"), "dst").alias("inner"), "step", F.lit(True).alias("ahead")).unionByName(
            behind.select("src", "dst", F.struct("src", F.col("mid").alias("dst")).alias("inner"), "step", F.lit(False).alias("ahead"))
        )

    @staticmethod
    def _carry_back(links: DataFrame, walks: DataFrame) -> DataFrame:
        found = walks.select(F.col("src").alias("inner_src"), F.col("dst").alias("inner_dst"), "times", "path")
        longer = F.when(F.col("ahead"), F.concat(F.array("src"), "path")).otherwise(F.concat("path", F.array("dst")))
        return (
            links.select("src", "dst", F.col("inner.src").alias("inner_src"), F.col("inner.dst").alias("inner_dst"), "step", "ahead")
            .join(found, ["inner_src", "inner_dst"])
            .select("src", "dst", F.struct(_latest_first(F.col("step"), F.col("times")).alias("times"), longer.alias("path")).alias("walk"))
            .groupBy("src", "dst")
            .agg(F.min("walk").alias("best"))
            .select("src", "dst", "best.times", "best.path")
        )


def shortest_paths(edges: DataFrame, requests: DataFrame, max_hops: int | None = None) -> DataFrame:
    """The shortest path from ``src`` to ``dst`` for each request that has one.

    Among equally short paths the one with the lowest addresses is reported, and
    for each step the lowest hash. ``src`` may equal ``dst``. For few requests
    only the edges in their reach are gathered.
    """
    most = S.clamp_hops(max_hops)
    open_requests = materialize(requests.select("src", "dst").distinct(), "requests")
    few = open_requests.count() <= FEW_REQUESTS
    reach = edges_in_reach(edges, open_requests, most) if few else edges
    search = WalkSearch(collapse_pairs(reach, BY_ADDRESS), most)
    found = None
    for hops in range(1, most + 1):
        # One table holds what was found and, without a path, what is still open.
        walks = search.next(open_requests).select("src", "dst", "path")
        state = materialize(open_requests.join(walks, ["src", "dst"], "left"), f"walks{hops}")
        walks = state.filter("path IS NOT NULL").select("src", "dst", F.lit(hops).alias("hops"), "path")
        found = walks if found is None else found.unionByName(walks)
        open_requests = state.filter("path IS NULL").select("src", "dst")
    return with_hashes(found, edges)


def with_hashes(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Attach the lowest hash of every step; paths have at most four steps."""
    steps = walks.select("*", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("step", "a")).withColumn(
        "b", F.expr("path[step + 1]")
    )
    lowest = (
        edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), "hash")
        .join(steps.select("a", "b").distinct(), ["a", "b"], "left_semi")
        .groupBy("a", "b")
        .agg(F.min("hash").alias("hash"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("step", "hash")))
    return (
        steps.join(lowest, ["a", "b"])
        .groupBy(*walks.columns)
        .agg(F.transform(ordered, lambda s: s["hash"]).alias("hashes"))
    )


def return_paths(edges: DataFrame, transfers: DataFrame, max_hops: int | None = None) -> DataFrame:
    """For each distinct (from, to) the shortest path that leads from ``to`` back to ``from``."""
    requests = transfers.select(F.col("to_address").alias("src"), F.col("from_address").alias("dst"))
    found = shortest_paths(edges, requests, max_hops)
    return found.select(F.col("dst").alias("from_address"), F.col("src").alias("to_address"), "hops", "path", "hashes")


def trace_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The reported edges of each path, in order."""
    steps = paths.select("src", "dst", F.posexplode("hashes").alias("step", "hash"))
    return steps.join(edges.select("hash", "from_address", "to_address", "value", "timestamp"), "hash")


# ---------------------------------------------------------------- circular flows


def circular_flows(edges: DataFrame, limit: int | None = None, shortest: int = 2) -> DataFrame:
    """The first closed trails of two, then three edges, ordered by path and hashes.

    Works on node cycles first: every cycle holds at least one trail, so the first
    ``limit`` cycles hold the first ``limit`` trails, and only those are spelled out
    with hashes. Three-edge cycles are looked for only if two-edge ones do not
    suffice, or alone with ``shortest=3``.
    """
    n = S.clamp_limit(limit, 20, 100)
    pairs = materialize(
        edges.groupBy(F.col("from_address").alias("src"), F.col("to_address").alias("dst")).agg(
            F.count("*").alias("edges")
        ),
        "cycle-pairs",
    )
    if shortest >= 3:
        return _spell_out(_first_three_cycles(pairs, n), edges, 3, n)
    two = materialize(_spell_out(_first_cycles(_two_cycles(pairs), n), edges, 2, n), "cycles2")
    if two.count() >= n:
        return two
    three = _spell_out(_first_three_cycles(pairs, n), edges, 3, n)
    return _first_flows(two.unionByName(three), n)


def _first_three_cycles(pairs: DataFrame, n: int, first_starts: int = 256) -> DataFrame:
    """The first ``n`` closed three-step walks by path, without listing the others.

    Paths are ordered by their start, so the starts are taken in order, first
    ``first_starts`` of them and eight times as many with every round, until the
    starts taken have ``n`` cycles. A round reads only pairs that can close a walk
    from its starts. One range of starts is known to the driver as its last address.
    """
    leaving = pairs.select(F.col("src").alias("node")).distinct()
    nodes = materialize(leaving.join(pairs.select(F.col("dst").alias("node")), "node", "left_semi"), "cycle-starts")
    starts, after, found = first_starts, None, None
    while True:
        rest = nodes if after is None else nodes.filter(F.col("node") > after)
        last = rest.orderBy("node").limit(starts).agg(F.max("node")).first()[0]
        if last is None:
            return _first_cycles(_three_cycles(pairs.limit(0)) if found is None else found, n)
        taken = (F.lit(True) if after is None else F.col("node") > after) & (F.col("node") <= last)
        cycles = _first_cycles(_three_cycles(_closing_from(pairs, nodes.filter(taken))).filter(_starts_within(after, last)), n)
        found = materialize(cycles if found is None else _first_cycles(found.unionByName(cycles), n), "cycles3")
        if found.count() >= n:
            return found
        starts, after = starts * 8, last


def _starts_within(after: str | None, last: str) -> Column:
    start = F.col("path")[0]
    return start <= last if after is None else (start > after) & (start <= last)


def _closing_from(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """The pairs of which closed three-step walks from ``starts`` can be made.

    First steps leave a start, last ones enter one, and a middle step leads from
    where a first one ended to where a last one begins. Loops at both kinds of
    place are kept by the same rule.
    """
    src, dst = F.col("src"), F.col("dst")
    first = pairs.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    last = pairs.join(starts.select(F.col("node").alias("dst")), "dst", "left_semi")
    middle = pairs.join(first.select(dst.alias("src")).distinct(), "src", "left_semi").join(
        last.select(src.alias("dst")).distinct(), "dst", "left_semi"
    )
    kept = first.unionByName(last).unionByName(middle).select("src", "dst", "edges")
    return materialize(kept.distinct(), "cycle-pairs-near")


def _two_cycles(pairs: DataFrame) -> DataFrame:
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    there = pairs.filter("src <> dst").join(back, ["src", "dst"], "left_semi")
    loops = pairs.filter("src = dst AND edges >= 2")
    return there.unionByName(loops).select(F.array("src", "dst", "src").alias("path"))


def _three_cycles(pairs: DataFrame) -> DataFrame:
    """All closed three-step walks that have a trail, each rotation as its own row.

    A triangle is found once, at its corner with fewest neighbours, which bounds the
    candidate pairs by the number of pairs times the root of it; hubs never multiply.
    """
    loops = pairs.filter("src = dst")
    proper = pairs.filter("src <> dst").select("src", "dst")
    ends = proper.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = (
        proper.join(ends.select(F.col("node").alias("src"), F.col("degree").alias("src_degree")), "src")
        .join(ends.select(F.col("node").alias("dst"), F.col("degree").alias("dst_degree")), "dst")
        .withColumn("rises", F.struct("src_degree", "src") < F.struct(F.col("dst_degree").alias("src_degree"), F.col("dst").alias("src")))
    )
    leaving = ranked.filter("rises").select(F.col("src").alias("low"), F.col("dst").alias("next"))
    entering = ranked.filter("NOT rises").select(F.col("dst").alias("low"), F.col("src").alias("prev"))
    closing = proper.select(F.col("src").alias("next"), F.col("dst").alias("prev"))
    triangles = (
        leaving.join(entering, "low")
        .filter("next <> prev")
        .join(closing, ["next", "prev"], "left_semi")
        .select(
            F.explode(
                F.array(
                    F.array("low", "next", "prev", "low"),
                    F.array("next", "prev", "low", "next"),
                    F.array("prev", "low", "next", "prev"),
                )
            ).alias("path")
        )
    )
    # A loop at one end of a two-cycle also closes in three steps.
    back = proper.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = proper.join(back, ["src", "dst"], "left_semi")
    looped = mutual.join(loops.select("src"), "src", "left_semi").select(
        F.explode(
            F.array(
                F.array("src", "src", "dst", "src"),
                F.array("src", "dst", "src", "src"),
                F.array("dst", "src", "src", "dst"),
            )
        ).alias("path")
    )
    thrice = loops.filter("edges >= 3").select(F.array("src", "src", "src", "src").alias("path"))
    return triangles.unionByName(looped).unionByName(thrice)


def _first_cycles(cycles: DataFrame, n: int) -> DataFrame:
    return cycles.orderBy("path").limit(n)


def _spell_out(cycles: DataFrame, edges: DataFrame, hops: int, n: int) -> DataFrame:
    """Hash choices for at most n cycles, step by step, n per cycle after each step.

    Within a cycle the first n trails use, per pair, only its first n hashes (two
    more where a loop is walked repeatedly and hashes must differ). Hashes of
    different pairs never clash, and a loop walked repeatedly was required to have
    enough edges, so every kept start can be completed.
    """
    steps = F.array(*[F.struct(F.col("path")[i].alias("a"), F.col("path")[i + 1].alias("b")) for i in range(hops)])
    wanted = cycles.select(F.inline(steps)).distinct()
    by_hash = Window.partitionBy("a", "b").orderBy("hash")
    choice = (
        edges.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), "hash")
        .join(wanted, ["a", "b"], "left_semi")
        .withColumn("_n", F.row_number().over(by_hash))
        .filter(F.col("_n") <= n + 2)
        .drop("_n")
    )
    trails = cycles.withColumn("hashes", F.array().cast("array<string>"))
    order = Window.partitionBy("path").orderBy("hashes")
    for step in range(hops):
        trails = (
            trails.withColumns({"a": F.col("path")[step], "b": F.col("path")[step + 1]})
            .join(choice, ["a", "b"])
            .filter(~F.array_contains("hashes", F.col("hash")))
            .select("path", F.array_append("hashes", F.col("hash")).alias("hashes"))
            .withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= n)
            .drop("_n")
        )
    return _first_flows(trails.select(F.lit(hops).alias("hops"), "path", "hashes"), n)


def _first_flows(flows: DataFrame, n: int) -> DataFrame:
    return flows.orderBy("hops", "path", "hashes").limit(n)

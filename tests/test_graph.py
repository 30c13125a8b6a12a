import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import detectors as D
from ledgerscope.operators import graph as G
from ledgerscope.operators import paths as P
from tests.conftest import START


def random_rows(seed, nodes=7, count=28):
    rng = random.Random(seed)
    names = "abcdefghijklmnopqrst"[:nodes]
    return [(rng.choice(names), rng.choice(names), i) for i in range(count)]


def edge_list(rows):
    return [(f"h{i:03d}", r[0], r[1], r[2]) for i, r in enumerate(rows) if r[1] is not None]


def trails(edges, hops, directed=True):
    """Every trail of exactly ``hops`` edges as (nodes, hashes)."""
    steps = [(h, a, b) for h, a, b, _ in edges]
    if not directed:
        steps += [(h, b, a) for h, a, b, _ in edges if a != b]
    level = [((a, b), (h,)) for h, a, b in steps]
    for _ in range(hops - 1):
        level = [
            ((*nodes, b), (*hashes, h)) for nodes, hashes in level for h, a, b in steps if a == nodes[-1] and h not in hashes
        ]
    return level


@pytest.mark.parametrize("seed,few", [(1, 0), (2, 0), (2, 1000), (8, 1000)])
def test_shortest_paths_against_all_trails(spark, make, monkeypatch, seed, few):
    monkeypatch.setattr(P, "FEW_REQUESTS", few)
    rows = random_rows(seed, nodes=9, count=16)
    edges = edge_list(rows)
    nodes = sorted({n for _, a, b, _ in edges for n in (a, b)})
    requests = spark.createDataFrame(list(itertools.product(nodes, nodes)), "src string, dst string")
    found = P.shortest_paths(G.graph_edges(make.transactions(rows)), requests, 4)
    got = {(r.src, r.dst): (r.hops, tuple(r.path), tuple(r.hashes)) for r in found.collect()}
    expected = {}
    for hops in range(1, 5):
        level = {}
        for path, hashes in trails(edges, hops):
            key = (path[0], path[-1])
            level[key] = min(level.get(key, (path, hashes)), (path, hashes))
        for key, (path, hashes) in level.items():
            expected.setdefault(key, (hops, path, hashes))
    assert got == expected


def test_chain_and_depth(spark, make):
    rows = [("a", "b", 0), ("b", "c", 1), ("c", "d", 2), ("d", "e", 3)]
    edges = G.graph_edges(make.transactions(rows))
    request = spark.createDataFrame([("a", "e")], "src string, dst string")
    assert P.shortest_paths(edges, request, 3).count() == 0
    found = P.shortest_paths(edges, request, 4)
    assert found.first().path == list("abcde")
    steps = P.trace_edges(found, edges).orderBy("step").collect()
    assert [(s.from_address, s.to_address) for s in steps] == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_edges_in_reach_hold_every_walk(spark, make, hops):
    rows = random_rows(4, nodes=16, count=40)
    edges = G.graph_edges(make.transactions(rows))
    ends = [("a", "b"), ("c", "a")]
    reach = P.edges_in_reach(edges, spark.createDataFrame(ends, "src string, dst string"), hops)
    kept = {r.hash for r in reach.collect()}
    used = {h for n in range(1, hops + 1) for nodes, hashes in trails(edge_list(rows), n) if (nodes[0], nodes[-1]) in ends for h in hashes}
    assert used <= kept
    far = [r for r in edge_list(rows) if hops < 4 and not {r[1], r[2]} & {n for e in edge_list(rows) for n in e[1:3] if {e[1], e[2]} & {"a", "b", "c"}}]
    assert not {h for h, *_ in far} & kept


def test_few_requests_gather_few_edges(spark, make, monkeypatch):
    rows = [("a", "b", 0), ("b", "c", 1), ("c", "d", 2)] + [(f"x{i}", f"x{i + 1}", i) for i in range(60)]
    gathered = []
    monkeypatch.setattr(P, "collapse_pairs", lambda edges, order, real=P.collapse_pairs: gathered.append(edges.distinct().count()) or real(edges, order))
    request = spark.createDataFrame([("a", "d")], "src string, dst string")
    edges = G.graph_edges(make.transactions(rows))
    assert P.shortest_paths(edges, request, 3).first().path == list("abcd")
    monkeypatch.setattr(P, "FEW_REQUESTS", 0)
    assert P.shortest_paths(edges, request, 3).first().path == list("abcd")
    assert gathered == [3, 63]


def test_parallel_edges(spark, make):
    rows = [("a", "b", 0), ("a", "b", 1), ("b", "a", 2)]
    edges = G.graph_edges(make.transactions(rows))
    assert P.circular_flows(edges, 100).count() == 4
    request = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert P.shortest_paths(edges, request).first().hashes == ["h000"]


@pytest.mark.parametrize("seed,count,limit", [(3, 14, 100), (4, 12, 5), (5, 40, 100), (6, 9, 100)])
def test_circular_flows_against_all_trails(make, seed, count, limit):
    rows = random_rows(seed, nodes=5, count=count)
    edges = edge_list(rows)
    expected = sorted(
        (hops, nodes, hashes) for hops in (2, 3) for nodes, hashes in trails(edges, hops) if nodes[0] == nodes[-1]
    )[:limit]
    flows = P.circular_flows(G.graph_edges(make.transactions(rows)), limit).collect()
    assert sorted((r.hops, tuple(r.path), tuple(r.hashes)) for r in flows) == expected


def test_three_step_cycles_with_loops(make):
    rows = [("a", "a", 0), ("a", "a", 1), ("a", "a", 2), ("a", "b", 3), ("b", "a", 4), ("b", "c", 5), ("c", "a", 6)]
    expected = sorted(
        (hops, nodes, hashes) for hops in (2, 3) for nodes, hashes in trails(edge_list(rows), hops) if nodes[0] == nodes[-1]
    )
    flows = P.circular_flows(G.graph_edges(make.transactions(rows)), 100).collect()
    assert len(expected) < 100 and sorted((r.hops, tuple(r.path), tuple(r.hashes)) for r in flows) == expected


@pytest.mark.parametrize("starts,limit", [(1, 7), (1, 100), (2, 30), (256, 30)])
def test_three_step_cycles_start_by_start(make, starts, limit):
    """Few starts a round find what all of them find, loops and exhausted rounds included."""
    rows = [*random_rows(8, nodes=12, count=45), ("b", "b", 900), ("b", "b", 901)]
    pairs = G.graph_edges(make.transactions(rows)).groupBy(F.col("from_address").alias("src"), F.col("to_address").alias("dst")).agg(
        F.count("*").alias("edges")
    )
    walks = sorted({nodes for nodes, _ in trails(edge_list(rows), 3) if nodes[0] == nodes[-1]})
    found = P._first_three_cycles(pairs, limit, starts).collect()
    assert walks and sorted(tuple(r.path) for r in found) == walks[:limit]


def test_three_step_cycles_alone(make):
    rows = [("a", "b", 0), ("b", "a", 1), ("b", "c", 2), ("c", "a", 3), ("x", "y", 4)]
    edges = G.graph_edges(make.transactions(rows))
    assert {r.hops for r in P.circular_flows(edges, 100, shortest=3).collect()} == {3}
    assert P.circular_flows(edges.limit(0), 100, shortest=3).count() == 0


@pytest.mark.parametrize("depth,limit", [(1, 50), (2, 4), (2, 50), (3, 6), (3, 200)])
def test_neighbourhoods_against_all_trails(spark, make, depth, limit):
    rows = random_rows(7, nodes=8, count=13)
    edges = edge_list(rows)
    nodes = sorted({n for _, a, b, _ in edges for n in (a, b)})
    centers = spark.createDataFrame([(n,) for n in nodes], "address string")
    paths = G.neighbourhood_paths(G.graph_edges(make.transactions(rows)), centers, depth, limit)
    got = sorted((r.center, tuple(e.hash for e in r.edges), tuple(r.nodes)) for r in paths.collect())
    expected = []
    for center in nodes:
        ordered = []
        for hops in range(1, depth + 1):
            ordered += sorted((h, n) for n, h in trails(edges, hops, directed=False) if n[0] == center)
        expected += [(center, h, n) for h, n in ordered[:limit]]
    assert got == sorted(expected)


def test_center_without_edges_is_shown_alone(make):
    ledger = make([("a", "b", 0), ("lone", None, 1)], entities=[("lone", "", "low", True, "seed")])
    edges = G.graph_edges(ledger.transactions)
    centers = ledger.accounts.select("address")
    paths = G.neighbourhood_paths(edges, centers)
    nodes = G.address_graph_nodes(paths, edges, centers, ledger.accounts, ledger.entities, ledger.flags)
    lone = nodes.filter("center = 'lone'").collect()
    assert [(r.node, r.entity_type, r.risk_level, r.is_hub, r.degree) for r in lone] == [("lone", "wallet", "low", True, 0)]
    graph = G.address_graph(paths, centers, ledger.accounts).filter("center = 'lone'").first()
    assert graph.nodes == ["lone"] and graph.edges == []


def brute_force_circular(rows):
    """Replay in time order: shortest return path over the edges present at that time."""
    found = {}
    for i, row in enumerate(rows):
        sender, to, minute = row[:3]
        if to is None or (len(row) > 4 and row[4]):
            continue
        present = [(h, a, b, m) for h, a, b, m in edge_list(rows) if m <= minute]
        for hops in (1, 2, 3):
            if any(n[0] == to and n[-1] == sender for n, _ in trails(present, hops)):
                found[f"h{i:03d}"] = hops
                break
    return found


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_circular_detection_against_replay(make, seed):
    rng = random.Random(seed)
    rows = [(*r, 1, rng.choice([None, None, b"x"])) for r in random_rows(seed, nodes=8, count=24)]
    flags = D.detect_circular(make.transactions(rows)).collect()
    assert {r.tx_hash: r.hops for r in flags} == brute_force_circular(rows)
    times = {}
    for h, a, b, m in edge_list(rows):
        times[a, b] = min(times.get((a, b), m), m)
    for flag in flags:
        path = flag.description.split(": ")[1].split(" -> ")
        at = (flag.detected_at - START) / dt.timedelta(minutes=1)
        assert len(path) == flag.hops + 1 and all(times[p] <= at for p in zip(path, path[1:]))


def test_late_return_flags_the_later_transfer_only(make):
    flags = D.detect_circular(make.transactions([("a", "b", 0), ("b", "a", 1), ("s", "s", 2)])).collect()
    assert {(r.tx_hash, r.address, r.severity) for r in flags} == {("h001", "b", "high"), ("h002", "s", "high")}


def test_duplicate_nodes(spark):
    later = START + dt.timedelta(hours=1)
    upper, lower = "0x" + "AB" * 20, "0x" + "ab" * 20
    nodes = spark.createDataFrame(
        [(1, lower, None, later, later), (2, upper, True, START, None), (3, "x", False, START, START)],
        "node_id long, address string, is_contract boolean, first_seen timestamp, last_seen timestamp",
    )
    edges = spark.createDataFrame([(1, "h", 3), (2, "h", 3), (3, "g", 2)], "from_id long, hash string, to_id long")
    merged, repaired = G.merge_duplicates(nodes, edges)
    assert {tuple(r) for r in merged.collect()} == {(1, lower, True, START, later), (3, "x", False, START, START)}
    assert {(r.from_id, r.hash, r.to_id) for r in repaired.collect()} == {(1, "h", 3), (3, "g", 1)}
    assert tuple(G.duplicate_summary(nodes).first()) == (1, 1)

"""Velocity, value and hub detectors on ledgers made by hand, and against plain Python."""

import datetime as dt
import random
from collections import Counter

from ledgerscope.operators import detectors as D

from .conftest import START


def velocity(df, **settings):
    return {(r.address, r.bucket): (r.total_count, r.baseline_count, r.tx_hash) for r in D.detect_velocity(df, **settings).collect()}


def test_a_burst_after_a_quiet_day(make):
    rows = [("a", "b", 60 * h) for h in range(0, 20, 5)] + [("a", "c", 60 * 21 + m) for m in range(6)]
    got = velocity(make.transactions(rows), ratio=3, minimum=5)
    hour = START + dt.timedelta(hours=21)
    # Hours without transfers count as zero without having rows.
    assert got == {("a", hour): (6, 4, "h009"), ("c", hour): (6, 0, "h009")}
    assert velocity(make.transactions(rows), ratio=36, minimum=5) == {("c", hour): (6, 0, "h009")}
    assert velocity(make.transactions(rows), ratio=3, minimum=7) == {}


def test_the_baseline_is_the_hours_before_only(make):
    rows = [("a", "b", 0)] * 8 + [("a", "b", 60 * 24)] * 5 + [("a", "b", 60 * 49)] * 5
    got = velocity(make.transactions(rows), ratio=10, minimum=5)
    assert {(a, int((t - START).total_seconds()) // 3600): v[:2] for (a, t), v in got.items() if a == "a"} == {("a", 0): (8, 0), ("a", 24): (5, 8), ("a", 49): (5, 0)}


def test_recent_hours_are_judged_alike(make):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("abcd"), rng.randrange(60 * 80)) for _ in range(250)]
    df = make.transactions(rows)
    everything = velocity(df, ratio=2, minimum=3)
    since = START + dt.timedelta(hours=40, minutes=30)
    assert velocity(df, ratio=2, minimum=3, since=since) == {k: v for k, v in everything.items() if k[1] >= START + dt.timedelta(hours=40)}
    counts = Counter((x, minute // 60) for a, b, minute in rows for x in (a, b))
    for (address, hour), n in counts.items():
        before = sum(counts[address, h] for h in range(hour - 24, hour))
        flagged = (address, START + dt.timedelta(hours=hour)) in everything
        assert flagged == (n >= 3 and n * 24 > 2 * before)


def test_since_reaches_the_scan(spark, make, tmp_path):
    make.transactions([("a", "b", m) for m in range(5)]).write.parquet(str(tmp_path / "tx"))
    stored = spark.read.parquet(str(tmp_path / "tx"))
    for found in (D.detect_velocity(stored, ratio=1, minimum=1, since=START), D.detect_high_value(stored, threshold=1, since=START)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(timestamp" in plan and "data" not in plan.split("ReadSchema")[1]


def test_high_values_include_the_threshold(make):
    df = make.transactions([("a", "b", 0, 99, None), ("a", "b", 1, 100, None), ("a", None, 2, 10**37, None)])
    assert [(r.tx_hash, r.address, int(r.value)) for r in D.detect_high_value(df, threshold=100).orderBy("tx_hash").collect()] == [
        ("h001", "a", 100),
        ("h002", "a", 10**37),
    ]
    assert D.detect_high_value(make.transactions([]), threshold=1).count() == 0


ENTITIES = [("x", "exchange", "low", False, "seed"), ("m", "wallet", "low", True, "seed"), ("w", "wallet", "low", False, "seed")]


def test_partners_of_hubs_are_flagged(make):
    rows = [("a", "x", 0), ("x", "b", 1), ("w", "a", 2), ("m", "x", 3), ("x", "x", 4), ("x", None, 5), ("c", "d", 6)]
    ledger = make(rows, entities=ENTITIES)
    got = {(r.tx_hash, r.address, r.hub, r.description) for r in D.detect_hub(ledger.transactions, ledger.entities, min_degree=100, parts=3).collect()}
    assert got == {
        ("h000", "a", "x", "a interacts with x (exchange)"),
        ("h001", "b", "x", "b interacts with x (exchange)"),
        ("h003", "m", "x", "m interacts with x (exchange)"),
        ("h003", "x", "m", "x interacts with m (wallet)"),
    }


def test_degree_makes_a_hub(make):
    rng = random.Random(7)
    rows = [("hub", f"n{rng.randrange(40)}", i) if i % 3 == 0 else (f"n{rng.randrange(40)}", rng.choice(["hub", f"n{rng.randrange(40)}", None]), i) for i in range(400)]
    df = make.transactions(rows)
    degree = Counter(x for a, b, _ in rows if b is not None for x in (a, b))
    for parts in (1, 7):
        got = {(r.tx_hash, r.address, r.hub, r.degree) for r in D.detect_hub(df, make([]).entities, min_degree=25, parts=parts).collect()}
        expected = set()
        for i, (a, b, _) in enumerate(rows):
            if b is not None and a != b:
                expected |= {(f"h{i:03d}", x, y, degree[y]) for x, y in ((a, b), (b, a)) if degree[y] >= 25}
        assert got == expected
    some = df.filter("hash < 'h050'")
    assert {r.tx_hash for r in D.detect_hub(df, make([]).entities, min_degree=25, candidates=some).collect()} == {t for t, *_ in expected if t < "h050"}


def test_edges_of_a_hub_are_spread(spark, make):
    """No task gets more than its share of a hub's rows in the join."""
    df = make.transactions([("hub", f"n{i}", i) for i in range(600)])
    nodes = D.monitored_nodes(df, make([]).entities, 100, 16)
    rows = nodes.filter("address = 'hub'").collect()
    assert sorted(r.part for r in rows) == list(range(16)) and {r.degree for r in rows} == {600}
    sides = df.select(D.edge_part(16).alias("part")).groupBy("part").count().collect()
    assert max(r["count"] for r in sides) < 2 * 600 / 16

import numpy as np
import pytest

from ledgerscope.operators import detectors as D
from ledgerscope.operators import knn
from ledgerscope.operators import vectors as V


def clustered(seed, count, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    vectors = centres[rng.integers(0, 5, count)] + 0.1 * rng.normal(size=(count, dims))
    vectors[::7] = vectors[0]  # a large group of copies
    vectors[3] = 0.0
    return [(f"v{i:03d}", [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]


def brute_force(queries, pool, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    expected = {}
    for name, v in queries:
        if any(v):
            others = [(-round(float(unit(v) @ unit(w)), 9), other) for other, w in pool if other != name and any(w)]
            expected[name] = [other for _, other in sorted(others)[:k]]
    return expected


@pytest.mark.parametrize("tile_rows", [None, 16, 60, 1000])
def test_neighbours_against_brute_force(spark, tile_rows):
    """The scan, and grids of tiles of several sizes, agree with comparing all pairs."""
    how = {"scan_numbers": 0, "tile_rows": tile_rows} if tile_rows else {}
    rows = clustered(1, 150)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    found = knn.nearest_neighbours(df, None, 4, **how).orderBy("id", "position").collect()
    got = {}
    for r in found:
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute_force(rows, rows, 4)
    queries = [("new", rows[10][1]), *rows[:30]]
    asked = spark.createDataFrame(queries, "id string, vector array<float>")
    got = {}
    for r in knn.nearest_neighbours(asked, df, 3, **how).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute_force(queries, rows, 3)


def test_distance_limit_keeps_close_neighbours(spark):
    rows = clustered(2, 120)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    everything = {tuple(r) for r in knn.nearest_neighbours(df, None, 1).filter("similarity >= 0.98").collect()}
    near = {tuple(r) for r in knn.nearest_neighbours(df, None, 1, 0.2, scan_numbers=0, tile_rows=30).filter("similarity >= 0.98").collect()}
    assert near == everything and near


def test_single_precision_loses_no_neighbour(monkeypatch):
    """Vectors nearer to each other than single precision can tell, in strips of a few columns."""
    rng = np.random.default_rng(4)
    pool = np.repeat(rng.normal(size=(3, 6)), 40, axis=0) + 1e-7 * rng.normal(size=(120, 6))
    pool /= np.linalg.norm(pool, axis=1)[:, None]
    pool[5:9] = pool[4]
    rank = rng.permutation(120)
    monkeypatch.setattr(knn, "BLOCK_CELLS", 700)
    rows, columns, similar = knn._first(pool[:50], pool, rank, 7, -2.0)
    exact = np.round(pool[:50] @ pool.T, 9)
    for i in range(50):
        best = np.lexsort((rank, -exact[i]))[:7]
        assert columns[rows == i].tolist() == best.tolist() and np.allclose(similar[rows == i], exact[i][best], atol=1e-12)


def test_vectors_are_copied_once_a_row_of_tiles(spark):
    rows = [(f"v{i:04d}", [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    shared = knn.materialize(knn._distinct_vectors(df, 3), "shared")
    grid = knn._tiles(shared, shared, 3, -2.0, 25)
    assert grid.groupBy("uid").count().filter("count <> 4 * 3").count() == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    some = spark.createDataFrame(clustered(3, 5), "id string, vector array<float>")
    assert knn.nearest_neighbours(none, None, 3).count() == 0
    assert knn.nearest_neighbours(none, some, 3).count() == 0
    assert knn.nearest_neighbours(some, none, 3).count() == 0


def test_similar_bytecode_flags(spark, make):
    code = [("c", b"\x60\x80\x60\x40" * 20), ("d", b"\x60\x80\x60\x40" * 20), ("e", bytes(range(200)))]
    ledger = make([("a", "c", 0, 1, b"x"), ("a", "e", 1, 1, b"x"), ("a", "d", 2)], code=code)
    contracts = V.contract_vectors(ledger.bytecode)
    flags = D.detect_similar_bytecode(ledger.transactions, ledger.bytecode, V.similar_contracts(contracts, 1)).collect()
    assert [(r.tx_hash, r.address, r.severity) for r in flags] == [("h000", "c", "high")]
    assert flags[0].description == "Contract c is 1.00 similar to d based on pgvector bytecode fingerprints"
    raised = spark.createDataFrame([("c", "similar_bytecode")], "address string, flag_type string")
    assert {r.address: r.flagged for r in D.mark_flagged(contracts, raised).collect()} == {"c": True, "d": False, "e": False}


def test_highlights_prefer_feature_order(make):
    ledger = make([("a", "b", 0), ("b", "a", 0)])
    features = V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of))
    match = V.similar_accounts(features, ledger.accounts, ledger.entities, ledger.flags).filter("address = 'a'").first()
    assert match.highlights == ["similar activity volume", "similar incoming volume", "similar send/receive balance"]
    assert match.similarity == pytest.approx(1.0)


def test_copies_of_a_vector_do_not_grow_with_the_pool(spark):
    """However small tiles are asked for, there are not more than the cores need; all neighbours are still found."""
    rows = clustered(5, 300)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    shared = knn.materialize(knn._distinct_vectors(df, 3), "shared")
    tiles = knn._tiles(shared, shared, 3, -2.0, 1)
    side = int((4 * spark.sparkContext.defaultParallelism) ** 0.5)
    assert tiles.groupBy("uid").count().filter(f"count > {side} * 9").count() == 0
    got = {}
    for r in knn.nearest_neighbours(df, None, 4, scan_numbers=0, tile_rows=1).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute_force(rows, rows, 4)


def test_many_short_vectors_go_to_tiles(spark, monkeypatch):
    """Vectors that fit into a scan by their numbers are dealt into tiles if there are many of them."""
    monkeypatch.setattr(knn, "SCAN_ROWS", 100)
    monkeypatch.setattr(knn, "_scan", lambda *_: pytest.fail("scanned"))
    rows = clustered(6, 150, dims=3)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = {}
    for r in knn.nearest_neighbours(df, None, 4).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute_force(rows, rows, 4)


def neighbours(found):
    got = {}
    for r in found.orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    return got


def test_tiles_are_read_and_not_shuffled(spark, monkeypatch):
    """Many packs on both sides, more than a task holds at once: no exchange carries vectors, and all neighbours are found."""
    monkeypatch.setattr(knn, "PACK_ROWS", 20)
    monkeypatch.setattr(knn, "HELD_NEIGHBOURS", 150)
    rows = clustered(8, 210)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    shared = knn.materialize(knn._distinct_vectors(df, 3), "shared")
    grid = knn._tiles(shared, shared, 3, -2.0, 25)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert neighbours(knn.nearest_neighbours(df, None, 4, scan_numbers=0, tile_rows=25)) == brute_force(rows, rows, 4)


def test_queries_of_their_own_are_read_and_not_shuffled(spark, monkeypatch):
    """The same for queries against another pool, also where all vectors have the same hash."""
    monkeypatch.setattr(knn, "PACK_ROWS", 20)
    monkeypatch.setattr(knn, "_key", lambda _: knn.F.lit(1).cast("long"))
    rows, queries = clustered(9, 130), [(f"q{i}", v) for i, (_, v) in enumerate(clustered(10, 90))]
    df, asked = (spark.createDataFrame(r, "id string, vector array<double>") for r in (rows, queries))
    tables = [knn.materialize(knn._distinct_vectors(d, 3), "shared") for d in (asked, df)]
    assert "Exchange" not in knn._tiles(*tables, 3, -2.0, None)._jdf.queryExecution().executedPlan().toString()
    assert neighbours(knn.nearest_neighbours(asked, df, 3, scan_numbers=0)) == brute_force(queries, rows, 3)


def test_memory_of_a_worker():
    """Fingerprints of much code and neighbours that are all alike take a bounded number of megabytes beside their inputs."""
    import tracemalloc

    import pandas as pd

    from ledgerscope.functions import fingerprint

    rng = np.random.default_rng(7)
    codes = pd.Series([rng.bytes(40000) for _ in range(200)])
    pool = 1 + 1e-6 * rng.normal(size=(4096, 128))
    pool /= np.linalg.norm(pool, axis=1)[:, None]
    peaks = []
    tracemalloc.start()
    for work in (lambda: fingerprint._fingerprints.func(codes), lambda: knn._first(pool[:256], pool, np.arange(4096), 6, -2.0)):
        tracemalloc.reset_peak()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
    tracemalloc.stop()
    assert max(peaks) < 150

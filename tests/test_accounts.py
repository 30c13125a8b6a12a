import datetime as dt

from ledgerscope.operators import accounts as A
from ledgerscope.operators import graph as G
from ledgerscope.operators import labels as L
from ledgerscope.operators import records as R
from ledgerscope.operators import series as TS
from ledgerscope.operators import vectors as V
from ledgerscope.plans import documents as docs
from tests.conftest import START


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


def test_transfer_to_oneself_counts_twice_except_in_lists_and_behaviour(make):
    ledger = make([("a", "a", 0)])
    profile = rows_by(docs.profile_summary(ledger), "address")["a"]
    assert (profile.sent_count, profile.received_count, profile.total_count) == (1, 1, 2)
    partner = A.counterparties(ledger.transactions).first()
    assert (partner.counterparty, partner.sent_count, partner.received_count, partner.total_count) == ("a", 1, 1, 2)
    assert A.address_velocity(ledger.transactions, ledger.as_of).first().total_count == 2
    assert G.node_degrees(G.graph_edges(ledger.transactions)).first().degree == 2
    assert A.recent_for_accounts(ledger.transactions).count() == 1
    stats = V.behavior_stats(ledger.transactions, ledger.as_of).first()
    assert (stats.sent_count, stats.received_count) == (1, 0)


def test_label_precedence(make):
    ledger = make(
        [("a", "b", 0)],
        entities=[("a", "wallet", "none", False, "seed"), ("b", "wallet", "high", False, "seed")],
        flags=[(1, "h000", "a", "x", "high", 0), (2, "h000", "b", "x", "low", 0)],
    )
    by_label = rows_by(L.risk_by_label(ledger.accounts, ledger.entities, ledger.flags), "address")
    by_flags = rows_by(L.risk_by_flags(ledger.accounts, ledger.entities, ledger.flags), "address")
    assert (by_label["a"].risk_level, by_label["b"].risk_level) == ("none", "high")
    assert (by_flags["a"].risk_level, by_flags["b"].risk_level) == ("high", "low")


def test_contract_creation(make):
    ledger = make([("a", None, 0), ("a", "b", 1)])
    assert R.enqueue_jobs(ledger.transactions, ledger.jobs, ledger.as_of).count() == 1
    assert G.graph_edges(ledger.transactions).count() == 1
    assert [r.counterparty for r in A.counterparties(ledger.transactions).filter("address = 'a'").collect()] == ["b"]
    point = TS.network_metrics(ledger.transactions, ledger.as_of).first()
    assert (point.transaction_count, point.unique_addresses, point.total_value) == (2, 2, "200")


def test_contracts_need_a_call_and_code(make):
    ledger = make(
        [("a", "c", 0, 1, b"x"), ("a", "d", 1, 1, b"x"), ("a", "e", 2)], code=[("c", b"code"), ("e", b"code"), ("d", b"")]
    )
    kinds = {r.address: r.is_contract for r in ledger.accounts.collect()}
    assert kinds == {"a": False, "c": True, "d": False, "e": False}


def test_accounts_merge_keeps_contract_mark(make):
    first = make([("a", "c", 0, 1, b"x")], code=[("c", b"code")]).accounts
    later = make([("c", "a", 9)]).accounts
    merged = rows_by(A.merge_accounts(first, later), "address")
    assert merged["c"].is_contract and merged["c"].first_seen == START
    assert merged["c"].last_seen == START + dt.timedelta(minutes=9)


def test_seed_labels(spark, make):
    ledger = make(
        [("a", "b", 0)],
        entities=[("a", "wallet", "low", False, "manual"), ("b", "wallet", "low", False, "seed")],
    )
    seeds = spark.createDataFrame(
        [("a", "A2", "dex", "high", True), ("b", "B2", "dex", "high", True), (" C ", "C2", "dex", "high", True)],
        "address string, name string, entity_type string, risk_level string, is_hub boolean",
    )
    merged = rows_by(L.merge_seed_labels(ledger.entities, seeds, ledger.as_of), "address")
    assert (merged["a"].name, merged["a"].source, merged["a"].written) == ("A", "manual", False)
    assert (merged["b"].name, merged["b"].source, merged["b"].written) == ("B2", "seed", True)
    assert (merged["C"].name, merged["C"].written) == ("C2", True)


def test_flag_deduplication(make):
    flags = make(
        [("a", "b", 0)],
        flags=[(1, "t", "a", "x", "low", 5), (2, "t", "a", "x", "high", 3), (3, None, "a", "x", "low", 0), (4, None, "a", "x", "low", 0)],
    ).flags
    assert sorted(r.id for r in R.oldest_flags(flags).collect()) == [2, 3, 4]
    assert sorted(r.id for r in R.newest_flags(flags).collect()) == [2, 3, 4]
    assert R.new_flags(flags.filter("id = 1"), flags.filter("id = 2")).count() == 0


def test_empty_tables(make):
    ledger = make([])
    overview = TS.overview_stats(ledger.transactions, ledger.accounts, ledger.flags, ledger.jobs).first()
    assert (overview.transaction_count, overview.account_count, overview.latest_transaction_at) == (0, 0, None)
    status = TS.enrichment_status(ledger.jobs).first()
    assert (status.pending, status.max_attempts, status.oldest_pending_at) == (0, 0, None)
    assert TS.network_metrics(ledger.transactions, ledger.as_of).count() == 0


def test_idle_account_has_zero_features(spark, make):
    ledger = make([("a", "b", 0)])
    accounts = ledger.accounts.select("address").union(spark.createDataFrame([("idle",)], "address string"))
    features = V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of))
    idle = V.with_embedding(V.complete_features(features, accounts)).filter("address = 'idle'").first()
    assert idle.sample_size == 0 and all(idle[n] == 0 for n in V.FEATURES) and set(idle.embedding) == {0.0}


def test_jobs_fold_and_lease(spark):
    minutes = lambda m: START + dt.timedelta(minutes=m)
    events = spark.createDataFrame(
        [("t", "claimed", None, minutes(0), 1), ("t", "failed", "boom", minutes(1), 2), ("t", "claimed", None, minutes(2), 3),
         ("d", "claimed", None, minutes(0), 1), ("d", "failed", "x", minutes(1), 2), ("d", "done", None, minutes(2), 3)],
        "tx_hash string, kind string, error string, at timestamp, seq long",
    )
    state = rows_by(R.latest_job_state(events), "tx_hash")
    assert (state["t"].status, state["t"].attempts, state["t"].last_error) == ("processing", 2, "boom")
    assert state["t"].available_at == minutes(1) + dt.timedelta(seconds=15) and state["t"].locked_at == minutes(2)
    assert (state["d"].status, state["d"].last_error, state["d"].locked_at) == ("done", None, None)


def test_series_compression_matches_slices(spark):
    for n in (1, 7, 8, 9, 13, 24, 100):
        points = [(START + dt.timedelta(hours=i), i + 1, 2 * i + 1, float(i), str(10**20 + i)) for i in range(n)]
        df = spark.createDataFrame(
            points, "bucket timestamp, transaction_count long, unique_addresses long, avg_gas_price double, total_value string"
        )
        got = TS.compress_series(df, 8).orderBy("bucket").collect()
        if n <= 8:
            assert [r.transaction_count for r in got] == [p[1] for p in points]
            continue
        for i, row in enumerate(got):
            part = points[i * n // 8 : (i + 1) * n // 8]
            assert row.transaction_count == sum(p[1] for p in part)
            assert row.unique_addresses == int(sum(p[2] for p in part) / len(part) + 0.5)
            assert row.total_value == str(sum(int(p[4]) for p in part))
            assert row.bucket == part[-1][0] and row.avg_gas_price == part[-1][3]

import datetime as dt
import glob
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import schemas
from ledgerscope.operators import detectors as D
from ledgerscope.operators import records as R
from ledgerscope.operators import vectors as V
from ledgerscope.operators.accounts import merge_accounts
from ledgerscope.plans import documents as docs
from ledgerscope.sources import landing, star
from ledgerscope.sources.ledger import read_ledger, write_ledger
from ledgerscope.streaming import ingest as ST
from ledgerscope.streaming.store import BatchStore, VersionedTable
from tests.conftest import START

SF = "/root/testdata/sf0.001"


def test_ingest_from_json_in_several_batches(spark, tmp_path):
    """Three landing files, a redelivery in a later file, and rows that cannot be stored."""
    at = lambda m: START + dt.timedelta(minutes=m)
    files = [
        [("h1", "a", "b", "1", 1, "1", 0, b"x", at(0)), ("bad", "a", "b", "1" * 50, 1, "1", 0, None, at(1))],
        [("h1", "a", "b", "1", 1, "1", 0, b"x", at(5)), ("h2", "a", "", None, 1, None, 1, None, at(6))],
        [(None, "a", "b", "1", 1, "1", 0, None, at(7)), (None, "c", "b", "1", 1, "1", 0, None, at(7))],
    ]
    for rows in files:
        landing.write_json(spark.createDataFrame(rows, schemas.RAW_TRANSACTIONS).coalesce(1), str(tmp_path / "in"), "append")
    store = BatchStore(str(tmp_path / "out"))
    raw = landing.stream_pending(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    ST.start_ingest(raw, store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    rows = store.read(spark, "transactions", schemas.TRANSACTIONS).orderBy("hash").collect()
    assert [(r.hash, r.to_address, r.data, r.timestamp) for r in rows] == [("h1", "b", b"x", at(0)), ("h2", None, None, at(6))]
    problems = store.read(spark, "quarantine", ST.QUARANTINE).collect()
    assert sorted(r.problem for r in problems) == ["no hash", "no hash", "value does not fit"]


def stream_events(spark, tmp_path, parts):
    """The event table as ``parts`` files in time order."""
    events = star.table(spark, SF, "events")
    step = 1000 // parts
    for i in range(parts):
        part = events.filter(f"event_id >= {i * step} AND event_id < {(i + 1) * step}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    return star.as_transactions(star.shape_events(stream).selectExpr("*", "0L AS nonce"))


def test_enrichment_in_batches_equals_one_batch_run(spark, tmp_path):
    store = BatchStore(str(tmp_path / "store"), merge_every=2)
    code = star.bytecode(spark, SF)
    stream = stream_events(spark, tmp_path, 4)
    ST.start_enrichment(stream, store, lambda: code, str(tmp_path / "check"), availableNow=True).awaitTermination()
    ledger = star.load(spark, SF)

    raised = store.read(spark, "flags", ST.RAISED)
    expected = {(r.tx_hash, r.severity, r.description) for r in D.detect_circular(ledger.transactions).collect()}
    assert {(r.tx_hash, r.severity, r.description) for r in raised.filter("flag_type = 'circular_flow'").collect()} == expected
    assert raised.count() == raised.select("tx_hash", "address", "flag_type").distinct().count()

    per_batch = store.read(spark, "accounts", ST.ACCOUNTS).drop("batch")
    merged = merge_accounts(per_batch.limit(0), per_batch)
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in ledger.accounts.collect()}
    assert store.read(spark, "vectors", ST.VECTORS).count() == 98


def test_replayed_batch_changes_nothing(spark, tmp_path, make):
    store = BatchStore(str(tmp_path / "store"))
    for name, schema in ST.ENRICHMENT_TABLES.items():
        store.create(spark, name, schema)
    ledger = make([("a", "b", 0), ("b", "a", 1)])
    for _ in range(2):
        ST.enrich_batch(ledger.transactions, 0, store, ledger.bytecode)
    assert store.read(spark, "flags", ST.RAISED).count() == 1
    assert store.read(spark, "pairs", ST.PAIRS).count() == 2


def test_calls_wait_for_their_code(spark, tmp_path, make):
    store = BatchStore(str(tmp_path / "store"))
    for name, schema in ST.ENRICHMENT_TABLES.items():
        store.create(spark, name, schema)
    family = b"\x60\x80" * 30
    early = make([("a", "c", 0, 1, b"x"), ("a", "d", 1, 1, b"x")], code=[("d", family)])
    ST.enrich_batch(early.transactions, 0, store, early.bytecode)
    assert store.read(spark, "flags", ST.RAISED).count() == 0
    later = make([("x", "y", 5)], code=[("c", family), ("d", family)])
    ST.enrich_batch(later.transactions, 1, store, later.bytecode)
    assert {(r.tx_hash, r.address) for r in store.read(spark, "flags", ST.RAISED).collect()} == {("h000", "c")}
    ST.enrich_batch(later.transactions, 2, store, later.bytecode)
    assert store.read(spark, "flags", ST.RAISED).count() == 1


def ingest(spark, tmp_path, files):
    for rows in files:
        landing.write_json(spark.createDataFrame(rows, schemas.RAW_TRANSACTIONS).coalesce(1), str(tmp_path / "in"), "append")
    store = BatchStore(str(tmp_path / "out"))
    raw = landing.stream_pending(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    ST.start_ingest(raw, store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    good = [(r.hash, r.timestamp) for r in store.read(spark, "transactions", schemas.TRANSACTIONS).orderBy("hash").collect()]
    bad = sorted((r.hash, r.problem) for r in store.read(spark, "quarantine", ST.QUARANTINE).collect())
    return good, bad


def test_late_rows_and_late_repeats(spark, tmp_path):
    """A row far older than the stream's latest is stored; a repeat fifteen hours later is not."""
    at = lambda h: START + dt.timedelta(hours=h)
    row = lambda name, hour: (name, "a", "b", "1", 1, "1", 0, None, at(hour))
    good, bad = ingest(spark, tmp_path, [[row("h1", 20)], [row("h2", 40)], [row("h3", 6)], [row("h1", 55)], [row("h3", 6)]])
    assert good == [("h1", at(20)), ("h2", at(40)), ("h3", at(6))] and bad == []


def test_amounts_are_whole_and_bad_rows_keep_no_hash(spark, tmp_path):
    row = lambda name, value: (name, "a", "b", value, 1, "1", 0, None, START)
    good, bad = ingest(spark, tmp_path, [[row("h1", "1.7"), row("h2", "-5"), row("h3", "7")], [row("h1", "2"), row("h2", "-5")]])
    assert [name for name, _ in good] == ["h1", "h3"]
    assert bad == [("h1", "value does not fit"), ("h2", "value does not fit")]


def test_code_written_while_the_stream_runs(spark, tmp_path, make):
    """Calls wait in one run of the stream and are resolved in the next, which sees code written in between."""
    family = b"\x60\x80" * 30
    store = BatchStore(str(tmp_path / "store"), merge_every=2)
    code = str(tmp_path / "code")
    stored = lambda: spark.read.schema(schemas.BYTECODE).parquet(code)
    first = make([("a", "c", 0, 1, b"x"), ("a", "d", 1, 1, b"x")], code=[("d", family)])
    first.bytecode.write.parquet(code)
    first.transactions.write.parquet(str(tmp_path / "tx"))
    stream = spark.readStream.schema(schemas.TRANSACTIONS).parquet(str(tmp_path / "tx"))
    query = ST.start_enrichment(stream, store, stored, str(tmp_path / "check"), processingTime="1 second")
    try:
        query.processAllAvailable()
        assert store.read(spark, "flags", ST.RAISED).count() == 0
        make([], code=[("c", family)]).bytecode.write.mode("append").parquet(code)
        for minute in range(5, 10):
            make([("x", "y", minute)]).transactions.withColumn("hash", F.lit(f"t{minute}")).write.mode("append").parquet(str(tmp_path / "tx"))
            query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.tx_hash, r.address) for r in store.read(spark, "flags", ST.RAISED).collect()} == {("h000", "c")}
    assert len(store.runs(0, 5)) == 2


def test_tiers_hold_every_batch_once(spark, tmp_path):
    """Every batch sees all earlier ones in few runs, each row is written once a tier, and merged runs go."""
    store = BatchStore(str(tmp_path), merge_every=3)
    schema = T.StructType([T.StructField("n", T.LongType())])
    for batch in range(28):
        for _ in range(2 if batch in (9, 18) else 1):  # replayed where two tiers end
            store.merge(spark, "t", schema, batch, lambda rows: rows)
            store.write(spark.createDataFrame([(batch,)], schema), "t", batch)
        if batch in (0, 1, 3, 8, 9, 13, 18, 26, 27):
            assert sorted(r.n for r in store.upto(spark, "t", schema, batch).collect()) == list(range(batch + 1))
        assert len(store.runs(0, batch)) <= 2 * 4
    assert store.read(spark, "t", schema).count() == 28
    kept = sorted(os.path.relpath(p, tmp_path / "_t") for p in glob.glob(str(tmp_path / "_t" / "*" / "*")))
    assert "tier=3/before=27" in kept and "tier=2/before=9" in kept and "tier=1/before=3" not in kept


def test_calls_resolved_in_another_run_than_they_waited_in(spark, tmp_path, make):
    """What waits in one tier's run is taken off by what resolves it in a later run."""
    store = BatchStore(str(tmp_path / "store"), merge_every=2)
    for name, schema in ST.ENRICHMENT_TABLES.items():
        store.create(spark, name, schema)
    family = b"\x60\x80" * 30
    waits = make([("a", "c", 0, 1, b"x")], code=[("d", family)])
    ST.enrich_batch(waits.transactions, 0, store, waits.bytecode)
    idle = lambda n, code: ST.enrich_batch(make([("x", "y", n)]).transactions.withColumn("hash", F.lit(f"t{n}")), n, store, make([], code=code).bytecode)
    idle(1, [("d", family)])
    idle(2, [("d", family)])
    for n in range(3, 9):
        idle(n, [("c", family), ("d", family)])
    assert [r.batch for r in store.read(spark, "resolved", ST.RESOLVED).collect()] == [3]
    assert store.before(spark, "waiting", schemas.TRANSACTIONS, 8).count() == 0
    assert store.before(spark, "resolved", ST.RESOLVED, 8).count() == 0


VERSIONED = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("at", T.LongType())])


def test_versioned_upserts_with_a_reader_in_between(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"), VERSIONED, ("k",), merge_every=2)
    rows = lambda *r: spark.createDataFrame(list(r), VERSIONED)
    state = lambda df: {r.k: (r.v, r.at) for r in df.collect()}
    assert table.version() == -1 and table.read().count() == 0
    extra = rows(("a", [1], 5), ("a", [2], 7), ("b", None, None), (None, [9], 9)).withColumn("_version", F.lit("clash")).withColumn("row", F.lit(1))
    assert table.upsert(extra, newest="at") == 0
    reader = table.read()
    assert table.upsert(rows(("b", [3], 1), ("c", [], 2))) == 1
    assert state(reader) == {"a": ([2], 7), "b": (None, None)}
    assert state(table.read()) == {"a": ([2], 7), "b": ([3], 1), "c": ([], 2)}
    assert state(table.read(0)) == state(reader)

    # A writer that dies before its pointer leaves the last version in force.
    table._store.write(rows(("a", [99], 0)).withColumn("_version", F.lit(2).cast("long")), "rows", 2)
    assert table.version() == 1 and state(table.read())["a"] == ([2], 7)
    for n in range(2, 9):
        assert table.upsert(rows((f"n{n}", [n], n), ("a", [n], n))) == n
    assert table.upsert(rows()) == 9
    assert state(table.read()) == {"a": ([8], 8), "b": ([3], 1), "c": ([], 2), **{f"n{n}": ([n], n) for n in range(2, 9)}}
    assert state(table.read(7))["a"] == ([7], 7)


def test_behaviour_vectors_are_replaced_for_accounts_that_moved(spark, tmp_path):
    ledger = star.load(spark, SF)
    middle = ledger.as_of - dt.timedelta(days=1)
    stored = V.behavior_store(spark, str(tmp_path / "vectors"))
    V.upsert_behavior(stored, ledger.transactions.filter(F.col("timestamp") <= F.lit(middle)), ledger.as_of)
    V.upsert_behavior(stored, ledger.transactions, ledger.as_of, since=middle)
    moved = spark.read.parquet(str(tmp_path / "vectors" / "rows" / "batch=1")).count()
    whole = V.with_embedding(V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of)))
    expected = {(r.address, r.sample_size, tuple(r.embedding)) for r in whole.collect()}
    assert {(r.address, r.sample_size, tuple(r.embedding)) for r in stored.read().collect()} == expected
    assert 0 < moved < len(expected)


def test_metrics_add_up_however_late(spark, tmp_path, make):
    store = BatchStore(str(tmp_path / "store"), merge_every=2)
    for minutes in ([600], [5], [601, 6], [7]):
        rows = [("a", "b", m, 10) for m in minutes]
        make(rows).transactions.write.mode("append").parquet(str(tmp_path / "tx"))
    stream = spark.readStream.schema(schemas.TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "tx"))
    ST.start_network_metrics(stream, store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    rows = ST.stored_network_metrics(spark, store).orderBy("bucket").collect()
    assert [(r.transaction_count, r.unique_addresses, r.avg_gas_price, int(r.total_value)) for r in rows] == [(3, 2, 10.0, 30), (2, 2, 10.0, 20)]


def test_snapshots(spark, tmp_path):
    ledger = star.load(spark, SF)
    stream = spark.readStream.schema(star.table(spark, SF, "events").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    query = ST.start_snapshots(
        stream, lambda: docs.snapshot(ledger), str(tmp_path / "snap"), str(tmp_path / "check"), "1 second"
    )
    query.processAllAvailable()
    query.stop()
    text = spark.read.text(str(tmp_path / "snap")).first()[0]
    assert '"overview":{"transaction_count":1000' in text and text.count('"why_flagged"') == 10


def test_ledger_round_trip(spark, tmp_path):
    ledger = star.load(spark, SF)
    write_ledger(ledger, str(tmp_path))
    again = read_ledger(spark, str(tmp_path))
    assert again.as_of == ledger.as_of
    assert {tuple(r) for r in again.accounts.collect()} == {tuple(r) for r in ledger.accounts.collect()}
    assert R.recent_flags(again.flags, 5).collect() == R.recent_flags(ledger.flags, 5).collect()
    assert V.contract_vectors(again.bytecode).count() == 200


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "2")], "transaction_count long, total_value string")
    landing.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().total_value == "2"


def test_job_states_do_not_depend_on_batches(spark, tmp_path):
    """Transitions out of order within and across batches, against the fold of the whole log; failed jobs become due."""
    from ledgerscope.streaming import jobs as SJ

    at = lambda m: START + dt.timedelta(minutes=m)
    log = [
        [("a", "claimed", None, at(0), 1), ("a", "failed", "no code", at(1), 2), ("b", "claimed", None, at(3), 1), ("c", "claimed", None, at(2), 1)],
        [("b", "failed", "late", at(2), 9), ("c", "done", None, at(2), 2), ("d", "failed", "x", at(4), 1), ("a", "claimed", None, at(5), 3)],
        [("a", "failed", "again", at(6), 4), ("d", "done", None, at(4), 0), ("e", "failed", "z", at(500), 1)],
    ]
    schema = "tx_hash string, kind string, error string, at timestamp, seq long"
    for rows in log:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = BatchStore(str(tmp_path / "store"))
    SJ.start_jobs(stream, store, str(tmp_path / "check"), lateness="2 hours", availableNow=True).awaitTermination()
    got = {r.tx_hash: tuple(r)[1:] for r in SJ.stored_jobs(spark, store).collect()}
    folded = R.latest_job_state(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert {k: v[:-1] for k, v in got.items()} == {r.tx_hash: tuple(r)[1:] for r in folded.collect()}
    assert {k: v[-1] for k, v in got.items()} == {"a": True, "b": False, "c": False, "d": True, "e": False}
    assert got["a"][:3] == ("pending", 2, "again")


def test_job_states_count_late_transitions_and_rows_of_due_jobs(spark, tmp_path):
    """However late a transition comes it counts; a job that waited is written once more when its moment has come."""
    from ledgerscope.streaming import jobs as SJ

    at = lambda h: START + dt.timedelta(hours=h)
    log = [[("a", "failed", "x", at(100), 1), ("b", "failed", "y", at(40), 1)], [("c", "claimed", None, at(110), 1)], [("c", "claimed", None, at(1), 0)], [("d", "done", None, at(130), 1), ("d", None, None, at(130), 2), ("d", "failed", "w", at(129), 1)]]
    schema = "tx_hash string, kind string, error string, at timestamp, seq long"
    for rows in log:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = BatchStore(str(tmp_path / "store"))
    SJ.start_jobs(stream, store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    written = sorted((r.tx_hash, r.due, r.batch) for r in store.read(spark, "jobs", SJ.STATES).collect())
    assert written == [("a", False, 0), ("a", True, 3), ("b", False, 0), ("b", True, 0), ("c", False, 1), ("c", False, 2), ("d", False, 3)]
    assert {r.tx_hash: r.attempts for r in SJ.stored_jobs(spark, store).collect()} == {"a": 0, "b": 0, "c": 2, "d": 0}
    assert {r.tx_hash: r.last_error for r in SJ.stored_jobs(spark, store).collect()} == {"a": "x", "b": "y", "c": None, "d": None}
    assert sorted(os.listdir(tmp_path / "store" / "waiting")) == ["batch=2", "batch=3"]


def test_job_streams_store_hashes_packed_and_once(spark, tmp_path):
    """What lands has no hashes, the state has them as bytes, the jobs of a batch are stored once; any text is a name."""
    from ledgerscope.streaming import jobs as SJ

    names = ["0x" + "0f" * 32, "0x" + "0F" * 32, "0x" + "0f" * 31, "", "a", "\x01" + "b" * 31, "ü" * 16, "0x" + "0f" * 32 + "\n", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    packed = df.select("name", SJ.packed_hash("name").alias("packed")).select("name", "packed", SJ.unpacked_hash("packed").alias("again")).collect()
    assert [r.again for r in packed] == names and len({r.packed for r in packed}) == len(names)
    assert [len(r.packed) for r in packed[:3]] == [33, 67, 65]

    moves = [(i % 400, i % 7, "RAN"[i % 3], START + dt.timedelta(days=i % 49)) for i in range(2000)]
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(moves, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    stream = star.landed_job_events(spark, str(tmp_path), str(tmp_path / "landed"))
    assert "tx_hash" not in spark.read.parquet(str(tmp_path / "landed" / "part-0")).columns
    store = BatchStore(str(tmp_path / "store"))
    SJ.start_jobs(stream, store, str(tmp_path / "check"), availableNow=True).awaitTermination()
    got = {tuple(r)[:-1] for r in SJ.stored_jobs(spark, store).collect()}
    assert got == {tuple(r) for r in R.latest_job_state(star.job_events(spark, str(tmp_path))).collect()} and len(got) == 400
    assert sorted(os.listdir(tmp_path / "store")) == ["clock", "jobs", "waiting"]
    moved = store.read(spark, "jobs", SJ.STATES).filter("not due")
    assert moved.count() == moved.select("tx_hash", "batch").distinct().count() > 400


def test_batches_do_not_depend_on_how_tables_are_split(spark, tmp_path, monkeypatch):
    """Tables of many files, landed in one or several files a part, come as as many batches as parts."""
    rows = [(i, START + dt.timedelta(minutes=i), i % 5, "click", 1.0, '{"k": 1}') for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    moves = [(i % 40, i, 1, 1, "R", START + dt.timedelta(days=i % 50)) for i in range(400)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(moves, schema).repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    for rows_a_file in (1 << 20, 30):
        monkeypatch.setattr(star, "LANDED_ROWS", rows_a_file)
        # The last part of the deliveries, 106 of the 400 by the hash, is not brought again.
        for land, parts, total in ((star.landed_events, 4, 400), (star.landed_deliveries, 4, 694), (star.landed_job_events, 2, 400)):
            to = str(tmp_path / f"{land.__name__}-{rows_a_file}")
            counts = []
            stream = land(spark, str(tmp_path), f"{to}/landed").writeStream.foreachBatch(lambda batch, _: counts.append(batch.count()))
            stream.option("checkpointLocation", f"{to}/check").trigger(availableNow=True).start().awaitTermination()
            assert len(counts) == parts and sum(counts) == total

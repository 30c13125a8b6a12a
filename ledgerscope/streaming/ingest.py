"""Live ingest, enrichment, metrics and snapshots with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerscope import schemas
from ledgerscope.operators import detectors as D
from ledgerscope.operators import records as R
from ledgerscope.operators import vectors as V
from ledgerscope.operators.accounts import build_accounts
from ledgerscope.session import materialize, scratch_path
from ledgerscope.sources import star
from ledgerscope.streaming.store import BatchStore

# Keeps the hashes a stream has seen on disk instead of in memory.
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# At most this many called addresses of a batch are handed to the scan of the code table by name.
FEW_ADDRESSES = 1000

QUARANTINE = T.StructType([*schemas.TRANSACTIONS.fields, T.StructField("problem", T.StringType())])
ACCOUNTS = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("balance", schemas.WEI),
        T.StructField("is_contract", T.BooleanType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)
PAIRS = T.StructType(
    [
        T.StructField("from_address", T.StringType()),
        T.StructField("to_address", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("bytecode", T.BinaryType()),
        T.StructField("embedding", schemas.EMBEDDING),
        T.StructField("flagged", T.BooleanType()),
    ]
)
RAISED = T.StructType(
    [
        T.StructField("tx_hash", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("flag_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
    ]
)


def deduplicated(raw: DataFrame) -> DataFrame:
    """A stream of checked rows in which each hash passes once, however late it is delivered again.

    The first good delivery passes, as for a ledger that refuses a hash it has.
    A bad delivery does not use up its hash: bad ones are told apart by their
    whole content. No row is dropped for being late, so the hashes seen are
    kept for good (on disk, 32 bytes of key each).
    """
    projected = R.project_raw(raw)
    content = F.concat(F.lit("bad "), F.sha2(F.to_json(F.struct(*projected.columns)), 256))
    key = F.when(F.col("problem").isNull(), F.col("hash")).otherwise(content)
    return projected.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def start_ingest(raw: DataFrame, store: BatchStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Append good rows to the ledger and set bad rows aside with their problem.

    Every delivery is in one of the two tables or repeats one that is.
    """
    raw.sparkSession.conf.set(STATE_CONF, DISK_STATE)
    store.create(raw.sparkSession, "transactions", schemas.TRANSACTIONS)
    store.create(raw.sparkSession, "quarantine", QUARANTINE)

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        store.write(R.accepted(rows), "transactions", batch_id)
        store.write(R.quarantined(rows), "quarantine", batch_id)
        rows.unpersist()

    stream = deduplicated(raw).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def _unique(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.dropDuplicates(list(names))


def _merge_state(spark: SparkSession, batch_id: int, store: BatchStore) -> None:
    """Fold what earlier batches left, so that later ones read few folders."""
    if not store.merged_tier(batch_id):
        return
    # Within one run; what was resolved later or before is matched where both are read or merged together.
    resolved = spark.read.schema(RESOLVED).parquet(*store.merged_folders("resolved", batch_id))
    waiting = spark.read.schema(schemas.TRANSACTIONS).parquet(*store.merged_folders("waiting", batch_id))
    folds = {
        "pairs": lambda rows: rows.groupBy("from_address", "to_address").agg(F.min("timestamp").alias("timestamp")),
        "vectors": _unique("address"),
        "flags": lambda rows: rows,
        "waiting": lambda rows: rows.join(resolved, "hash", "left_anti"),
        "resolved": lambda rows: rows.join(waiting.select("hash"), "hash", "left_anti"),
    }
    for table, fold in folds.items():
        store.merge(spark, table, ENRICHMENT_TABLES[table], batch_id, fold)


def _code_of(called: DataFrame, bytecode: DataFrame) -> DataFrame:
    """The stored code of the called addresses, read from the code table once.

    A few addresses become literals, which reach the Parquet scan.
    """
    wanted = materialize(called.select(F.col("to_address").alias("address")).distinct(), "called")
    few = [r.address for r in wanted.limit(FEW_ADDRESSES + 1).collect()]
    found = bytecode.filter(F.col("address").isin(few)) if len(few) <= FEW_ADDRESSES else bytecode.join(wanted, "address", "left_semi")
    return materialize(found, "called-code")


def enrich_batch(batch: DataFrame, batch_id: int, store: BatchStore, bytecode: DataFrame) -> None:
    """Accounts, graph, fingerprints and flags for one batch of ledger rows."""
    spark = batch.sparkSession
    _merge_state(spark, batch_id, store)
    waiting = store.before(spark, "waiting", schemas.TRANSACTIONS, batch_id).join(
        store.before(spark, "resolved", RESOLVED, batch_id), "hash", "left_anti"
    )

    # Pairs collapsed per batch are all the history that return paths need.
    plain_edges = batch.filter(F.col("to_address").isNotNull())
    pairs = plain_edges.groupBy("from_address", "to_address").agg(F.min("timestamp").alias("timestamp"))
    store.write(pairs, "pairs", batch_id)
    history = store.upto(spark, "pairs", PAIRS, batch_id)

    # Calls whose code is not known yet wait and are tried again with every batch.
    calls = batch.filter(F.col("to_address").isNotNull() & (F.octet_length("data") > 0))
    bytecode = _code_of(calls.select("to_address").unionByName(waiting.select("to_address")), bytecode)
    # Only called addresses can be contracts.
    store.write(build_accounts(batch, bytecode), "accounts", batch_id)
    known = bytecode.select(F.col("address").alias("to_address"))
    store.write(calls.join(known, "to_address", "left_anti").select(*schemas.TRANSACTIONS.fieldNames()), "waiting", batch_id)
    tried_again = waiting.join(known, "to_address", "left_semi")
    store.write(tried_again.select("hash"), "resolved", batch_id)
    ready = calls.unionByName(tried_again.select(*calls.columns))

    called = ready.select(F.col("to_address").alias("address")).distinct()
    stored = store.before(spark, "vectors", VECTORS, batch_id)
    fresh = bytecode.join(called, "address", "left_semi").join(stored.select("address"), "address", "left_anti")
    store.write(V.contract_vectors(fresh), "vectors", batch_id)
    vectors = store.upto(spark, "vectors", VECTORS, batch_id)

    circular = D.detect_circular(history, batch).select(*RAISED.fieldNames())
    nearest = V.nearest_stored(vectors.join(called, "address", "left_semi"), vectors, D.SIMILAR_DISTANCE)
    similar = D.detect_similar_bytecode(ready, bytecode, nearest).select(*RAISED.fieldNames())
    earlier = store.before(spark, "flags", RAISED, batch_id)
    store.write(R.new_flags(circular.unionByName(similar), earlier).select(*RAISED.fieldNames()), "flags", batch_id)


RESOLVED = T.StructType([T.StructField("hash", T.StringType())])
ENRICHMENT_TABLES = {
    "accounts": ACCOUNTS,
    "pairs": PAIRS,
    "vectors": VECTORS,
    "flags": RAISED,
    "waiting": schemas.TRANSACTIONS,
    "resolved": RESOLVED,
}


def start_enrichment(
    transactions: DataFrame, store: BatchStore, bytecode: Callable[[], DataFrame], checkpoint: str, **trigger
) -> StreamingQuery:
    """Enrich a stream of ledger rows.

    ``bytecode`` is called for every batch: a DataFrame keeps the list of files
    it was made with and would never see code written later.
    """
    for name, schema in ENRICHMENT_TABLES.items():
        store.create(transactions.sparkSession, name, schema)

    def enrich(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        enrich_batch(rows, batch_id, store, bytecode())
        rows.unpersist()

    stream = transactions.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


PARTIALS = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        T.StructField("address", T.StringType()),
        T.StructField("tx", T.LongType()),
        T.StructField("value", schemas.WEI),
        T.StructField("gas", schemas.WEI),
        T.StructField("priced", T.LongType()),
    ]
)


def _folded(partials: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast(PARTIALS[c].dataType).alias(c) for c in ("tx", "value", "gas", "priced")]
    return partials.groupBy("bucket", "address").agg(*sums)


def metric_partials(transactions: DataFrame, unit: str = "hour") -> DataFrame:
    """Counts and sums for each bucket and participant; the sender's row carries the amounts."""
    none = F.lit(None).cast(schemas.WEI)
    sides = F.array(
        F.struct(F.col("from_address").alias("address"), F.lit(1).cast("long").alias("tx"), "value", F.col("gas_price").alias("gas")),
        F.struct(F.col("to_address").alias("address"), F.lit(0).cast("long").alias("tx"), none.alias("value"), none.alias("gas")),
    )
    rows = transactions.select(F.date_trunc(unit, "timestamp").alias("bucket"), F.inline(sides))
    return _folded(rows.withColumn("priced", F.col("gas").isNotNull().cast("long")))


def start_network_metrics(
    transactions: DataFrame, store: BatchStore, checkpoint: str, unit: str = "hour", **trigger
) -> StreamingQuery:
    """Keep network metrics of a stream up to date.

    Every batch adds its partial sums by bucket and participant. They add up
    exactly, so a row counts in its bucket however late it comes, and the last
    bucket can be read before it is over.
    """
    store.create(transactions.sparkSession, "partials", PARTIALS)

    def save(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch.sparkSession, "partials", PARTIALS, batch_id, _folded)
        store.write(metric_partials(batch, unit), "partials", batch_id)

    stream = transactions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def stored_network_metrics(spark: SparkSession, store: BatchStore) -> DataFrame:
    """Network metrics over all buckets the stream has seen."""
    per_address = _folded(store.read(spark, "partials", PARTIALS).drop("batch"))
    totals = per_address.groupBy("bucket").agg(
        F.sum("tx").alias("transaction_count"),
        F.count("address").alias("unique_addresses"),
        F.sum("gas").alias("gas"),
        F.sum("priced").alias("priced"),
        F.sum("value").cast(schemas.WEI).alias("total_value"),
    )
    average = F.coalesce(F.col("gas").cast("double") / F.nullif(F.col("priced"), F.lit(0)), F.lit(0.0))
    return totals.select("bucket", "transaction_count", "unique_addresses", average.alias("avg_gas_price"), "total_value")


def start_snapshots(
    stream: DataFrame, build: Callable[[], DataFrame], path: str, checkpoint: str, period: str = "2 seconds"
) -> StreamingQuery:
    """Write a fresh snapshot document whenever the stream has moved, at most once per period."""

    def save(_: DataFrame, batch_id: int) -> None:
        build().write.mode("overwrite").text(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return query.trigger(processingTime=period).start()


# ---------------------------------------------------------------- runs over the test tables


def run_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries in several batches out of time order, with repeats much later."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = scratch_path(spark, "ingest")
    stream = star.landed_deliveries(spark, sf_dir, f"{root}/landed")
    start_ingest(stream, BatchStore(root), f"{root}/_checkpoint", availableNow=True).awaitTermination()
    rows = BatchStore(root).read(spark, "transactions", schemas.TRANSACTIONS)
    return rows.select("hash", "from_address", "to_address", F.col("value").cast("string").alias("value"))


def run_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in several batches, in time order, and compaction on the way."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = scratch_path(spark, "enrich")
    events = star.landed_events(spark, sf_dir, f"{root}/landed").withColumn("nonce", F.lit(0).cast("long"))
    store = BatchStore(root, merge_every=2)
    code = lambda: star.bytecode(spark, sf_dir)
    start_enrichment(star.as_transactions(events), store, code, f"{root}/_checkpoint", availableNow=True).awaitTermination()
    return store.read(spark, "flags", RAISED).select("tx_hash", "address", "flag_type", "severity", "detected_at")


def run_network_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in several batches; every bucket is there, the last one too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = scratch_path(spark, "metrics")
    events = star.landed_events(spark, sf_dir, f"{root}/landed", in_order=False).withColumn("nonce", F.lit(0).cast("long"))
    store = BatchStore(root, merge_every=2)
    start_network_metrics(star.as_transactions(events), store, f"{root}/_checkpoint", availableNow=True).awaitTermination()
    return stored_network_metrics(spark, store).withColumn("total_value", F.col("total_value").cast("string"))

"""Enrichment jobs as keyed state: attempts, the last error, and the moment of the next try."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerscope.operators.records import latest_job_state
from ledgerscope.session import scratch_path
from ledgerscope.sources import star
from ledgerscope.streaming.ingest import DISK_STATE, STATE_CONF
from ledgerscope.streaming.store import BatchStore, delete

STATES = T.StructType(
    [
        T.StructField("tx_hash", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("available_at", T.TimestampType()),
        T.StructField("locked_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("due", T.BooleanType()),
    ]
)
CLOCK = T.StructType([T.StructField("newest", T.TimestampType())])
STATE_COMPRESSION_CONF = "spark.sql.streaming.stateStore.rocksdb.compression"
HASH = r"^0x[0-9a-f]{64}\z"


def packed_hash(name: str) -> Column:
    """A name as bytes: a hash of 64 digits as 32 bytes behind a 1, any other text as it is behind a 0."""
    text = F.col(name)
    digits = F.concat(F.lit(bytearray(b"\x01")), F.unhex(F.substring(text, 3, 64)))
    return F.when(text.rlike(HASH), digits).otherwise(F.concat(F.lit(bytearray(b"\x00")), text.cast("binary")))


def unpacked_hash(name: str) -> Column:
    packed = F.col(name)
    rest = F.substring(packed, 2, 2**31 - 1)
    digits = F.concat(F.lit("0x"), F.lower(F.hex(rest)))
    return F.when(F.substring(packed, 1, 1) == F.lit(bytearray(b"\x01")), digits).otherwise(rest.cast("string"))


def start_jobs(events: DataFrame, store: BatchStore, checkpoint: str, lateness: str = "1 day", **trigger) -> StreamingQuery:
    """Keep the state of all jobs from a stream of transitions ``tx_hash, kind, error, at, seq``.

    Transitions may come in any order and however late: a job is folded in the
    stream's own state, by packed hash, and every batch writes a row for each job that moved.
    Event time is ``lateness`` behind the newest transition. When it has passed
    the moment at which a failed job may be tried again and the job has not moved
    since, its row is written once more with ``due``.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_CONF, DISK_STATE)
    spark.conf.set(STATE_COMPRESSION_CONF, "zstd")
    for table, schema in (("jobs", STATES), ("waiting", STATES), ("clock", CLOCK)):
        store.create(spark, table, schema)
    packed = events.withColumn("tx_hash", packed_hash("tx_hash"))
    states = latest_job_state(packed, unknown_ends=True).withColumns({"tx_hash": unpacked_hash("tx_hash"), "due": F.lit(False)})

    def save(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, "jobs", batch_id)
        _write_due(batch.sparkSession, batch_id, store, lateness)

    stream = states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def _write_due(spark: SparkSession, batch_id: int, store: BatchStore, lateness: str) -> None:
    """Beside the jobs that moved, write those whose moment has come; the others that are pending wait for a later batch.

    Batches read what the one before left, so a replay, which begins with the jobs that moved, changes nothing.
    """
    left = lambda table, schema, end=batch_id: spark.read.schema(schema).parquet(store.folder(table, 0, end))
    moved = left("jobs", STATES, batch_id + 1)
    # A job that moved has its latest transition in its row.
    newest = left("clock", CLOCK).unionByName(moved.select(F.col("updated_at").alias("newest"))).agg(F.max("newest").alias("newest"))
    now = newest.select("newest", (F.col("newest") - F.expr(f"INTERVAL {lateness}")).alias("event_time")).first()
    store.write(spark.createDataFrame([(now.newest,)], CLOCK).coalesce(1), "clock", batch_id)

    waited = left("waiting", STATES).join(moved.select("tx_hash"), "tx_hash", "left_anti").select(*STATES.fieldNames())
    pending = waited.unionByName(moved.filter(F.col("status") == "pending"))
    reached = F.coalesce(F.col("available_at") <= F.lit(now.event_time).cast("timestamp"), F.lit(False))
    # Written first: afterwards the folder of the batch holds more than the jobs that moved.
    store.write(pending.filter(~reached), "waiting", batch_id)
    store.write(pending.filter(reached).withColumn("due", F.lit(True)), "jobs", batch_id, more=True)
    if batch_id:
        for table in ("waiting", "clock"):
            delete(spark, store.folder(table, 0, batch_id - 1))


def stored_jobs(spark: SparkSession, store: BatchStore) -> DataFrame:
    """The latest state of each job; ``due`` if its retry moment has passed since it last moved."""
    rows = store.read(spark, "jobs", STATES)
    packed = rows.withColumn("tx_hash", packed_hash("tx_hash"))
    latest = packed.groupBy("tx_hash").agg(F.max_by(F.struct(*STATES.fieldNames()[1:]), F.struct("batch", "due")).alias("job"))
    return latest.select(unpacked_hash("tx_hash").alias("tx_hash"), "job.*")


def run_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log in two batches by time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = scratch_path(spark, "jobs")
    stream = star.landed_job_events(spark, sf_dir, f"{root}/landed")
    start_jobs(stream, BatchStore(root), f"{root}/_checkpoint", availableNow=True).awaitTermination()
    return stored_jobs(spark, BatchStore(root))

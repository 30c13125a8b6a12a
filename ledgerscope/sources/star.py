"""Derive a ledger from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.schemas import WEI
from ledgerscope.session import without_shuffle_files
from ledgerscope.sources.ledger import Ledger

# Fixed values of the mapping.
ENTITY_TYPES = ["wallet", "exchange", "stablecoin", "mixer", "bridge"]
RISK_LEVELS = ["none", "low", "medium", "high"]
FLAG_TYPES = ["circular_flow", "similar_bytecode", "velocity_spike", "unknown_signal"]
SEVERITIES = ["low", "medium", "high"]
JOB_STATUS = {"F": "done", "O": "pending", "P": "processing"}

# Rows of one landed file, about: a landed part has as many files as its tables need.
LANDED_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addr(number: Column) -> Column:
    """A 40-digit hexadecimal address for a number."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number.cast("long"))), 40, "0"))


def txh(number: Column) -> Column:
    """A 64-digit hexadecimal hash for a number."""
    return F.concat(F.lit("0x"), F.sha2(number.cast("string"), 256))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _nonces(events: DataFrame) -> DataFrame:
    """Position of each event among those of its user.

    Users are numbered minute by minute (earlier minutes add an offset), so that
    one user with very many events is spread over many tasks.
    """
    keyed = events.withColumn("minute", F.date_trunc("minute", "timestamp"))
    per_minute = keyed.groupBy("user_id", "minute").agg(F.count("*").alias("n"))
    before = Window.partitionBy("user_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_minute.select("user_id", "minute", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("user_id", "minute").orderBy("timestamp", "event_id")
    return (
        keyed.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["user_id", "minute"], "left")
        .withColumn("nonce", (F.col("offset") + F.col("rank") - 1).cast("long"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(_nonces(_events(spark, sf_dir)))


def as_transactions(events: DataFrame) -> DataFrame:
    """Ledger rows for shaped events that carry a nonce."""
    wei_per_cent = F.lit(10**16).cast("decimal(17,0)")
    gwei = F.lit(10**9).cast("decimal(10,0)")
    return events.select(
        txh(F.col("event_id")).alias("hash"),
        addr(F.col("user_id")).alias("from_address"),
        F.when(F.col("event_type") != "signup", addr(F.col("k"))).alias("to_address"),
        (F.round(F.col("value") * 100).cast("long").cast("decimal(19,0)") * wei_per_cent).cast(WEI).alias("value"),
        (F.lit(21000) + F.col("event_id") % 50000).cast("long").alias("gas"),
        ((F.col("event_id") % 97 + 1).cast("decimal(19,0)") * gwei).cast(WEI).alias("gas_price"),
        "nonce",
        F.lit(0).cast("long").alias("block_number"),
        F.when(F.col("event_type").isin("click", "view"), F.encode("props", "UTF-8")).alias("data"),
        "timestamp",
    )


def bytecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        addr(F.col("doc_id")).alias("address"),
        F.encode("text", "UTF-8").alias("bytecode"),
        (F.col("n_chars") > 0).alias("has_code"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        addr(F.col("page_id")).alias("address"),
        F.lit(None).cast("string").alias("abi"),
        F.col("html").alias("source_code"),
        F.lit(None).cast("string").alias("decompiled_code"),
        F.concat(F.lit("v0.8."), (F.col("page_id") % 30).cast("string")).alias("compiler_version"),
        (F.col("page_id") % 2 == 0).alias("verified"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        addr(key).alias("address"),
        F.col("n_name").alias("name"),
        pick(ENTITY_TYPES, F.col("n_regionkey")).alias("entity_type"),
        pick(RISK_LEVELS, key % 4).alias("risk_level"),
        (key % 5 == 0).alias("is_hub"),
        F.when(key % 6 == 0, "manual").otherwise("seed").alias("source"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels delivered by a second party; their addresses overlap those of ``entities``."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        addr(key).alias("address"),
        F.col("s_name").alias("name"),
        pick(ENTITY_TYPES, key % 5).alias("entity_type"),
        pick(RISK_LEVELS, F.col("s_nationkey") % 4).alias("risk_level"),
        (key % 3 == 0).alias("is_hub"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("id"),
            txh(F.col("event_id")).alias("tx_hash"),
            addr(F.col("user_id")).alias("address"),
            pick(FLAG_TYPES, k % 4).alias("flag_type"),
            pick(SEVERITIES, F.col("event_id") % 3).alias("severity"),
            F.when(k % 10 != 0, F.concat(F.lit("k="), k.cast("string"))).alias("description"),
            F.col("timestamp").alias("detected_at"),
        )
    )


def repeated_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals before deduplication: one per line item, many with the same key."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        ((key * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("id"),
        txh(key).alias("tx_hash"),
        F.when(F.col("l_suppkey") % 10 != 0, addr(F.col("l_suppkey") % 50)).alias("address"),
        pick(FLAG_TYPES, F.col("l_partkey") % 4).alias("flag_type"),
        F.col("l_shipdate").cast("timestamp").alias("detected_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in JOB_STATUS.items() for x in pair])
    attempts = (F.col("o_orderkey") % 4).cast("int")
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        txh(F.col("o_orderkey")).alias("tx_hash"),
        F.element_at(status, F.col("o_orderstatus")).alias("status"),
        attempts.alias("attempts"),
        F.when(attempts > 1, "timeout").alias("last_error"),
        day.alias("available_at"),
        F.when(F.col("o_orderstatus") == "P", day).alias("locked_at"),
        day.alias("updated_at"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "lineitem"))


def as_job_events(lines: DataFrame) -> DataFrame:
    """A log of job transitions: each line item moves the job of its order."""
    kind = F.element_at(
        F.create_map(F.lit("A"), F.lit("claimed"), F.lit("R"), F.lit("failed"), F.lit("N"), F.lit("done")),
        F.col("l_returnflag"),
    )
    return lines.select(
        txh(F.col("l_orderkey")).alias("tx_hash"),
        kind.alias("kind"),
        F.when(kind == "failed", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("error"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        F.col("l_linenumber").cast("long").alias("seq"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_deliveries(_events(spark, sf_dir))


def as_deliveries(events: DataFrame) -> DataFrame:
    """Raw deliveries: every event arrives, and each error event again five minutes later.

    Some amounts cannot be stored: too long, with a fraction, or negative.
    """
    again = F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spaced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), addr(F.col("user_id")))).otherwise(
        addr(F.col("user_id"))
    )
    return events.withColumn("copy", F.explode(again)).select(
        txh(F.col("event_id")).alias("hash"),
        spaced.alias("from"),
        F.when(F.col("event_type") != "signup", addr(F.col("k"))).otherwise("").alias("to"),
        F.when(F.col("event_type") == "signup", F.lit(None))
        .when(F.col("k") == 99, F.concat(F.lit("1"), F.repeat(F.lit("0"), 40)))
        .when(F.col("k") == 98, F.lit("1.7"))
        .when(F.col("k") == 97, F.lit("-5"))
        .otherwise(F.concat(F.round(F.col("value") * 100).cast("long").cast("string"), F.repeat(F.lit("0"), 16)))
        .alias("value"),
        (F.lit(21000) + F.col("event_id") % 50000).cast("long").alias("gas"),
        F.concat((F.col("event_id") % 97 + 1).cast("string"), F.repeat(F.lit("0"), 9)).alias("gas_price"),
        F.lit(0).cast("long").alias("nonce"),
        F.when(F.col("event_type").isin("click", "view"), F.encode("props", "UTF-8")).alias("data"),
        (F.col("timestamp") + F.make_interval(mins=F.col("copy") * 5)).alias("received_at"),
    )


def duplicated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes as racing writers leave them: one per address and event type."""
    return (
        _node_touches(spark, sf_dir)
        .groupBy("address", "event_type")
        .agg(
            F.min("touch_id").alias("node_id"),
            F.bool_or("called").alias("is_contract"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
        .select("node_id", _spelled("address").alias("address"), "event_type", "is_contract", "first_seen", "last_seen")
    )


def duplicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between those nodes; each is also present between the oldest nodes of its ends."""
    nodes = _node_touches(spark, sf_dir).groupBy("address", "event_type").agg(F.min("touch_id").alias("node_id"))
    oldest = nodes.groupBy("address").agg(F.min("node_id").alias("oldest_id"))
    ids = nodes.join(oldest, "address")
    ends = (
        _events(spark, sf_dir)
        .filter(F.col("event_type") != "signup")
        .select("event_id", "event_type", addr(F.col("user_id")).alias("src"), addr(F.col("k")).alias("dst"))
    )
    src = ids.select(F.col("address").alias("src"), "event_type", F.array("node_id", "oldest_id").alias("src_ids"))
    dst = ids.select(F.col("address").alias("dst"), "event_type", F.array("node_id", "oldest_id").alias("dst_ids"))
    return (
        ends.join(src, ["src", "event_type"])
        .join(dst, ["dst", "event_type"])
        .withColumn("pair", F.explode(F.arrays_zip("src_ids", "dst_ids")))
        .select(F.col("pair.src_ids").alias("from_id"), txh(F.col("event_id")).alias("hash"), F.col("pair.dst_ids").alias("to_id"))
    )


def _spelled(name: str) -> Column:
    """Writers of 'view' events spell addresses in upper case."""
    upper = F.concat(F.lit("0x"), F.upper(F.substring(name, 3, 40)))
    return F.when(F.col("event_type") == "view", upper).otherwise(F.col(name))


def _node_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).filter(F.col("event_type") != "signup")
    called = F.col("event_type").isin("click", "view")
    sides = F.array(
        F.struct(addr(F.col("user_id")).alias("address"), (F.col("event_id") * 2).alias("touch_id"), F.lit(False).alias("called")),
        F.struct(addr(F.col("k")).alias("address"), (F.col("event_id") * 2 + 1).alias("touch_id"), called.alias("called")),
    )
    return events.select("event_type", "timestamp", F.inline(sides))


def _landed(parts: list[DataFrame], rows: int, path: str) -> DataFrame:
    """A stream that brings one part of about ``rows`` rows with every batch, one after the other.

    All parts have the same number of files, which the source takes in the order they were
    written in; so the number of batches does not depend on how the tables are split.
    """
    files = max(1, rows // LANDED_ROWS)
    with without_shuffle_files(parts[0].sparkSession):
        for i, part in enumerate(parts):
            part.repartition(files).write.parquet(f"{path}/part-{i}")
    return parts[0].sparkSession.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part-*")


def landed_deliveries(spark: SparkSession, sf_dir: str, path: str, parts: int = 4) -> DataFrame:
    """Deliveries as a stream of several batches.

    The batches do not follow the time of the rows, and each but the first also
    brings rows of the one before again, fifteen hours later.
    """
    rows = deliveries(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(parts)))
    later = rows.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 15 HOURS"))
    landed = [rows.filter(F.col("part") == 0)]
    landed += [rows.filter(F.col("part") == i).unionByName(later.filter(F.col("part") == i - 1)) for i in range(1, parts)]
    return _landed([part.drop("part") for part in landed], 2 * table(spark, sf_dir, "events").count() // parts, path)


def landed_events(spark: SparkSession, sf_dir: str, path: str, parts: int = 4, in_order: bool = True) -> DataFrame:
    """The events as a stream of several batches, by time or across it."""
    events = table(spark, sf_dir, "events")
    bounds = events.select(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    step = (bounds[1] - bounds[0]) // parts + 1 if bounds[0] is not None else 1
    part = F.floor((F.col("event_id") - F.lit(bounds[0])) / step) if in_order else F.pmod(F.col("event_id"), F.lit(parts))
    return shape_events(_landed([events.filter(part == i) for i in range(parts)], bounds[2] // parts, path))


def landed_job_events(spark: SparkSession, sf_dir: str, path: str, parts: int = 2) -> DataFrame:
    """The job log as a stream of several batches, each a stretch of time. What lands are the columns it is made of."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    at = F.col("l_shipdate").cast("timestamp")
    bounds = lines.select(F.min(at), F.max(at), F.count("*")).first()
    step = (bounds[1] - bounds[0]) / parts if bounds[0] is not None else None
    landed = []
    for i in range(parts):
        later = F.lit(True) if i == 0 or step is None else at >= F.lit(bounds[0] + i * step)
        earlier = F.lit(True) if i + 1 == parts or step is None else at < F.lit(bounds[0] + (i + 1) * step)
        landed.append(lines.filter(later & earlier))
    return as_job_events(_landed(landed, bounds[2] // parts, path))


def event_stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The event files as a stream."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").options(**options)
    return shape_events(reader.parquet(sf_dir))


def load(spark: SparkSession, sf_dir: str) -> Ledger:
    """The whole ledger of one test directory."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Ledger(
        transactions=transactions(spark, sf_dir),
        bytecode=bytecode(spark, sf_dir),
        metadata=metadata(spark, sf_dir),
        entities=entities(spark, sf_dir),
        flags=flags(spark, sf_dir),
        jobs=jobs(spark, sf_dir),
    )

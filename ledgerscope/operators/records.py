"""Transactions, flags and enrichment jobs as stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.accounts import within_hours

# Fixed values of the job queue.
RETRY_SECONDS = 15
LEASE_MINUTES = 2

LISTED = ["hash", "from_address", "to_address", "value", "gas", "gas_price", "nonce", "block_number", "timestamp"]


def project_raw(raw: DataFrame) -> DataFrame:
    """Raw deliveries as ledger rows, with ``problem`` set where a row cannot be stored.

    Amounts are whole numbers, exact to 38 digits; fractions, signs and longer
    ones are reported, never rounded.
    """
    value = F.coalesce(S.empty_to_null(F.col("value")), F.lit("0"))
    gas_price = F.coalesce(S.empty_to_null(F.col("gas_price")), F.lit("0"))
    exact = {
        name: F.when(amount.rlike("^[0-9]+$"), amount).try_cast("decimal(38,0)")
        for name, amount in (("value", value), ("gas_price", gas_price))
    }
    return raw.select(
        F.col("hash"),
        S.normalize_address(F.col("from")).alias("from_address"),
        S.empty_to_null(S.normalize_address(F.col("to"))).alias("to_address"),
        exact["value"].alias("value"),
        F.col("gas").cast("long").alias("gas"),
        exact["gas_price"].alias("gas_price"),
        F.col("nonce").cast("long").alias("nonce"),
        F.lit(0).cast("long").alias("block_number"),
        F.when(F.octet_length("data") > 0, F.col("data")).alias("data"),
        F.col("received_at").alias("timestamp"),
        # Tested on the raw columns, so that a filter on the problem stays cheap when it is pushed down.
        F.when(F.coalesce("hash", F.lit("")) == "", "no hash")
        .when(S.is_blank(F.col("from")), "no sender")
        .when(exact["value"].isNull(), "value does not fit")
        .when(exact["gas_price"].isNull(), "gas price does not fit")
        .alias("problem"),
    )


def accepted(projected: DataFrame) -> DataFrame:
    return projected.filter(F.col("problem").isNull()).drop("problem")


def quarantined(projected: DataFrame) -> DataFrame:
    return projected.filter(F.col("problem").isNotNull())


def first_delivery(transactions: DataFrame) -> DataFrame:
    """One row per hash: the earliest delivery wins."""
    order = Window.partitionBy("hash").orderBy(
        F.asc_nulls_last("timestamp"), "from_address", F.asc_nulls_first("to_address"), "nonce"
    )
    return transactions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def enqueue_jobs(transactions: DataFrame, existing: DataFrame, as_of) -> DataFrame:
    """New pending jobs for transactions that have a recipient and no job yet."""
    new = transactions.filter(F.col("to_address").isNotNull()).select(F.col("hash").alias("tx_hash")).distinct()
    return new.join(existing.select("tx_hash"), "tx_hash", "left_anti").select(
        "tx_hash",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(as_of).alias("available_at"),
        F.lit(None).cast("timestamp").alias("locked_at"),
        F.lit(as_of).alias("updated_at"),
    )


def claimable_jobs(jobs: DataFrame, transactions: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Jobs that are due, free or abandoned, with their transaction; oldest first."""
    expired = F.col("locked_at") <= F.lit(as_of) - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES")
    due = jobs.filter(F.col("available_at") <= F.lit(as_of)).filter(
        (F.col("status") == "pending") | ((F.col("status") == "processing") & expired)
    )
    joined = due.select("tx_hash", "status", "attempts", "available_at", "updated_at").join(
        transactions, F.col("tx_hash") == F.col("hash")
    )
    if limit is None:
        return joined.drop("hash")
    return joined.drop("hash").orderBy("available_at", "updated_at", "tx_hash").limit(limit)


def latest_job_state(events: DataFrame, unknown_ends: bool = False) -> DataFrame:
    """Fold a log of claimed / failed / done events into one row per job.

    A claim adds an attempt and takes the lock; done clears the error; a failure
    keeps its text and makes the job due again after the retry delay. With
    ``unknown_ends`` events of other or no kind clear the error too.
    """
    moment = F.struct("at", "seq", "kind")
    kind = F.col("kind")
    ended = ~kind.eqNullSafe("claimed") if unknown_ends else kind.isin("failed", "done")
    folded = events.groupBy("tx_hash").agg(
        F.max(moment).alias("last"),
        F.count_if(kind == "claimed").alias("attempts"),
        F.max_by(F.when(kind == "failed", F.col("error")), F.when(ended, moment)).alias("last_error"),
        F.max(F.when(kind == "failed", F.col("at"))).alias("failed_at"),
        F.min("at").alias("first_at"),
    )
    last_kind = F.col("last.kind")
    return folded.select(
        "tx_hash",
        F.when(last_kind == "claimed", "processing").when(last_kind == "done", "done").otherwise("pending").alias("status"),
        F.col("attempts"),
        F.col("last_error"),
        F.coalesce(F.col("failed_at") + F.expr(f"INTERVAL {RETRY_SECONDS} SECONDS"), F.col("first_at")).alias("available_at"),
        F.when(last_kind == "claimed", F.col("last.at")).alias("locked_at"),
        F.col("last.at").alias("updated_at"),
    )


def oldest_flags(flags: DataFrame) -> DataFrame:
    """Unique by transaction, address and type; the first detection is kept.

    A flag without a transaction or address never equals another one.
    """
    return _one_flag_per_key(flags, F.asc("detected_at"), F.asc("id"))


def newest_flags(flags: DataFrame) -> DataFrame:
    """Unique by transaction, address and type; the highest id is kept."""
    return _one_flag_per_key(flags, F.desc("id"), F.desc("detected_at"))


def _one_flag_per_key(flags: DataFrame, *order) -> DataFrame:
    keys = ["tx_hash", "address", "flag_type"]
    complete = F.col("tx_hash").isNotNull() & F.col("address").isNotNull() & F.col("flag_type").isNotNull()
    # Incomplete flags pass in the same scan: a number of their own keeps them apart and spreads them out.
    alone = F.when(~complete, F.monotonically_increasing_id())
    ranked = flags.withColumn("_alone", alone)
    by_key = Window.partitionBy(*keys, "_alone").orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(by_key)).filter("_n = 1").drop("_n", "_alone")


def new_flags(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Flags not stored yet, one for each transaction, address and type (the earliest, then by text)."""
    once = _one_flag_per_key(found, F.asc("detected_at"), F.asc("severity"), F.asc("description"))
    return once.join(stored.select("tx_hash", "address", "flag_type"), ["tx_hash", "address", "flag_type"], "left_anti")


def listed_flags(flags: DataFrame) -> DataFrame:
    return flags.select(
        "id",
        F.coalesce("tx_hash", F.lit("")).alias("tx_hash"),
        "address",
        "flag_type",
        "severity",
        F.coalesce("description", F.lit("")).alias("description"),
        "detected_at",
    )


def flags_for_transactions(flags: DataFrame, hashes: DataFrame) -> DataFrame:
    """Flags attached to the given transaction hashes."""
    return listed_flags(flags.join(hashes.select(F.col("hash").alias("tx_hash")).distinct(), "tx_hash", "left_semi"))


def transactions_by_hash(transactions: DataFrame, hashes: DataFrame) -> DataFrame:
    return transactions.join(hashes.select("hash").distinct(), "hash", "left_semi")


def recent_transactions(transactions: DataFrame, limit: int | None = None) -> DataFrame:
    n = S.clamp_limit(limit, 50, 200)
    return transactions.select(*LISTED).orderBy(F.desc_nulls_first("timestamp"), "hash").limit(n)


def recent_flags(flags: DataFrame, limit: int | None = None) -> DataFrame:
    n = S.clamp_limit(limit, 50, 200)
    return listed_flags(flags).orderBy(F.desc_nulls_first("detected_at"), F.desc("id")).limit(n)


def recent_contracts(accounts: DataFrame, contracts: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest seen contracts with code size. Only the listed contracts are joined to their code."""
    n = S.clamp_limit(limit, 20, 100)
    latest = accounts.filter("is_contract").orderBy(F.desc_nulls_first("last_seen"), "address").limit(n)
    code = contracts.select("address", "flagged", F.octet_length("bytecode").alias("bytecode_size"))
    return latest.join(code, "address", "left").select(
        "address",
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        F.coalesce("bytecode_size", F.lit(0)).alias("bytecode_size"),
        "first_seen",
        "last_seen",
    )


def recent_window(transactions: DataFrame, as_of, hours: int) -> DataFrame:
    """The latest 50 transactions, as far as they fall into the window."""
    return within_hours(recent_transactions(transactions, 50), "timestamp", as_of, hours)


def contract_calls(transactions: DataFrame, bytecode: DataFrame) -> DataFrame:
    """Transactions that call an address with code."""
    coded = bytecode.filter("has_code").select(
        F.col("address").alias("to_address"), F.octet_length("bytecode").alias("bytecode_size")
    )
    calls = transactions.filter(F.col("to_address").isNotNull() & (S.octets(F.col("data")) > 0))
    return calls.join(coded, "to_address")


def circular_candidates(transactions: DataFrame) -> DataFrame:
    """Plain transfers: a recipient and no payload."""
    return transactions.filter(F.col("to_address").isNotNull() & (S.octets(F.col("data")) == 0))


def related_flag(transactions: DataFrame, flags: DataFrame) -> DataFrame:
    """Each transaction with the oldest of its flags, if any."""
    oldest = (
        flags.filter(S.empty_to_null(F.col("tx_hash")).isNotNull())
        .groupBy(F.col("tx_hash").alias("hash"))
        .agg(F.min_by(F.struct("address", "flag_type", "severity"), F.struct("detected_at", "id")).alias("flag"))
    )
    return transactions.join(oldest, "hash", "left").select(
        "hash",
        F.col("flag.flag_type").alias("flag_type"),
        F.col("flag.severity").alias("severity"),
        F.coalesce(F.col("flag.address"), F.col("to_address"), F.col("from_address")).alias("subject"),
    )

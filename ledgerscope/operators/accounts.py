"""The account dimension and its time- and activity-based views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.touches import distinct_touches, touches

ACCOUNT = ["address", "balance", "is_contract", "first_seen", "last_seen"]
ACTIVITY = ["sent_count", "received_count", "total_count", "total_sent", "total_received"]


def is_out() -> Column:
    return F.col("direction") == "out"


def is_in() -> Column:
    return F.col("direction") == "in"


def amount_text(amount: Column) -> Column:
    """Exact sums leave as text; no rows means '0'."""
    return F.coalesce(amount, F.lit(0).cast("decimal(38,0)")).cast("string")


def account_activity(transactions: DataFrame, bytecode: DataFrame) -> DataFrame:
    """Every participating address with its times, counts and exact amounts.

    One scan and one shuffle answer both what an account is and what it did;
    aggregates that a caller does not select are pruned from the plan. Contracts
    are called addresses that have code. Where ``transactions`` have a column
    ``payload``, it is the size of the payload.
    """
    called = is_in() & (F.col("payload") > 0)
    sized = transactions if "payload" in transactions.columns else transactions.withColumn("payload", S.octets(F.col("data")))
    seen = (
        touches(sized, "timestamp", "payload", "value")
        .groupBy("address")
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.bool_or(called).alias("called"),
            F.count_if(is_out()).alias("sent_count"),
            F.count_if(is_in()).alias("received_count"),
            F.count("*").alias("total_count"),
            F.sum(F.when(is_out(), F.col("value"))).alias("sent_value"),
            F.sum(F.when(is_in(), F.col("value"))).alias("received_value"),
        )
    )
    coded = bytecode.filter("has_code").select("address", F.lit(True).alias("coded"))
    return seen.join(coded, "address", "left").select(
        "address",
        F.lit(0).cast("decimal(38,0)").alias("balance"),
        (F.col("called") & F.coalesce("coded", F.lit(False))).alias("is_contract"),
        "first_seen",
        "last_seen",
        "sent_count",
        "received_count",
        "total_count",
        amount_text(F.col("sent_value")).alias("total_sent"),
        amount_text(F.col("received_value")).alias("total_received"),
    )


def build_accounts(transactions: DataFrame, bytecode: DataFrame) -> DataFrame:
    return account_activity(transactions, bytecode).select(*ACCOUNT)


def merge_accounts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch of accounts into the stored ones; being a contract is never undone."""
    return (
        existing.unionByName(batch)
        .groupBy("address")
        .agg(
            F.max("balance").alias("balance"),
            F.bool_or("is_contract").alias("is_contract"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def account_lookup(accounts: DataFrame, keys: DataFrame) -> DataFrame:
    """Accounts for the given addresses; an unknown address gives no row."""
    wanted = keys.select(S.normalize_address(F.col("address")).alias("address"))
    return accounts.join(wanted, "address", "left_semi")


def address_activity(account_activity: DataFrame) -> DataFrame:
    """Sent and received counts and amounts per address."""
    return account_activity.select("address", *ACTIVITY)


def top_addresses(account_activity: DataFrame, limit: int | None = None) -> DataFrame:
    """The most active addresses: most transfers, then latest seen."""
    n = S.clamp_limit(limit, 20, 100)
    return (
        account_activity.select("address", "is_contract", "first_seen", "last_seen", *ACTIVITY)
        .filter("total_count > 0")
        .orderBy(F.desc("total_count"), F.desc_nulls_first("last_seen"), "address")
        .limit(n)
    )


def active_candidates(transactions: DataFrame, limit: int = 6) -> DataFrame:
    """The address pool for behaviour comparison: the most active max(72, 12·limit)."""
    return (
        touches(transactions)
        .groupBy("address")
        .agg(F.count("*").alias("tx_count"))
        .orderBy(F.desc("tx_count"), "address")
        .limit(max(72, 12 * limit))
    )


def counterparties(transactions: DataFrame, limit: int | None = None) -> DataFrame:
    """Per address, the partners with most transfers (unlabelled)."""
    n = S.clamp_limit(limit, 8)
    totals = (
        touches(transactions, "value", "timestamp")
        .filter(F.col("counterparty").isNotNull())
        .groupBy("address", "counterparty")
        .agg(
            F.count_if(is_out()).alias("sent_count"),
            F.count_if(is_in()).alias("received_count"),
            F.count("*").alias("total_count"),
            F.sum("value").alias("total_value"),
            F.max("timestamp").alias("last_seen"),
        )
    )
    order = Window.partitionBy("address").orderBy(
        F.desc("total_count"), F.desc_nulls_first("last_seen"), "counterparty"
    )
    return totals.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def recent_for_accounts(transactions: DataFrame, limit: int | None = None, *keep: str) -> DataFrame:
    """Per address, its latest transactions; a transfer to oneself appears once."""
    n = S.clamp_limit(limit, 8)
    rows = distinct_touches(transactions, "hash", "timestamp", *keep)
    order = Window.partitionBy("address").orderBy(F.desc_nulls_first("timestamp"), "hash")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def address_velocity(transactions: DataFrame, as_of, bucket: str | None = None, hours: int | None = None) -> DataFrame:
    """Activity per address and time bucket over the last hours."""
    unit = S.bucket_unit(bucket)
    recent = within_hours(transactions, "timestamp", as_of, S.clamp_hours(hours))
    return (
        touches(recent, "value", "timestamp")
        .groupBy("address", F.date_trunc(unit, "timestamp").alias("bucket"))
        .agg(
            F.count_if(is_out()).alias("sent_count"),
            F.count_if(is_in()).alias("received_count"),
            F.count("*").alias("total_count"),
            amount_text(F.sum(F.when(is_out(), F.col("value")))).alias("sent_value"),
            amount_text(F.sum(F.when(is_in(), F.col("value")))).alias("received_value"),
            amount_text(F.sum("value")).alias("total_value"),
        )
    )


def velocity_peak(velocity: DataFrame) -> DataFrame:
    return velocity.groupBy("address").agg(
        F.max("total_count").alias("peak"), F.count("*").alias("buckets")
    )


def within_hours(df: DataFrame, column: str, as_of, hours: int) -> DataFrame:
    """Rows at most ``hours`` old, the bound included. The literal bound reaches the scan."""
    if as_of is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) >= F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))

"""Time series, overview counters, and what the dashboard derives from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.accounts import amount_text, within_hours


def network_metrics(transactions: DataFrame, as_of, bucket: str | None = None, hours: int | None = None) -> DataFrame:
    """Per bucket: transactions, distinct participants, average gas price, value moved.

    One scan: the sender row of each transaction also carries its amounts, so the
    distinct count and the sums share a single aggregation.
    """
    unit = S.bucket_unit(bucket)
    recent = within_hours(transactions, "timestamp", as_of, S.clamp_hours(hours))
    no_amount = F.lit(None).cast("decimal(38,0)")
    sides = F.array(
        F.struct(F.col("from_address").alias("address"), F.lit(1).alias("tx"), "value", "gas_price"),
        F.struct(
            F.col("to_address").alias("address"), F.lit(0).alias("tx"), no_amount.alias("value"), no_amount.alias("gas_price")
        ),
    )
    rows = recent.select(F.date_trunc(unit, "timestamp").alias("bucket"), F.inline(sides))
    return (
        rows.groupBy("bucket")
        .agg(
            F.sum("tx").alias("transaction_count"),
            F.count_distinct("address").alias("unique_addresses"),
            F.sum("gas_price").alias("gas"),
            F.count("gas_price").alias("priced"),
            F.sum("value").alias("value"),
        )
        .select(
            "bucket",
            "transaction_count",
            "unique_addresses",
            F.coalesce(F.col("gas").cast("double") / F.nullif(F.col("priced"), F.lit(0)), F.lit(0.0)).alias("avg_gas_price"),
            amount_text(F.col("value")).alias("total_value"),
        )
    )


def flag_series(flags: DataFrame, as_of, bucket: str | None = None, hours: int | None = None) -> DataFrame:
    unit = S.bucket_unit(bucket)
    recent = within_hours(flags, "detected_at", as_of, S.clamp_hours(hours))
    return recent.groupBy(F.date_trunc(unit, "detected_at").alias("bucket"), "flag_type", "severity").agg(
        F.count("*").alias("count")
    )


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Combine one-row results with different columns into a single row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_of_each(parts: list[DataFrame]) -> DataFrame:
    """One-row results with nested columns side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def overview_stats(transactions: DataFrame, accounts: DataFrame, flags: DataFrame, jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return _one_row(
        [
            transactions.agg(
                F.count("*").alias("transaction_count"), F.max("timestamp").alias("latest_transaction_at")
            ),
            accounts.agg(
                F.count("*").alias("account_count"), F.count_if(F.col("is_contract")).alias("contract_count")
            ),
            flags.agg(F.count("*").alias("flag_count")),
            jobs.agg(
                F.count_if(status == "pending").alias("pending_enrichment"),
                F.count_if(status == "processing").alias("processing_enrichment"),
                F.count_if(status == "done").alias("done_enrichment"),
            ),
        ]
    )


def enrichment_status(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "processing").alias("processing"),
        F.count_if(status == "done").alias("done"),
        F.count_if((status == "pending") & (F.col("attempts") > 0)).alias("retrying"),
        F.coalesce(F.max("attempts"), F.lit(0)).alias("max_attempts"),
        F.min(F.when(status == "pending", F.col("available_at"))).alias("oldest_pending_at"),
    )


# The operators below read a series of at most 720 hours of buckets, so an
# unpartitioned window is small whatever the size of the ledger.


def _numbered(points: DataFrame) -> DataFrame:
    order = Window.orderBy("bucket")
    return points.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))


def compress_series(points: DataFrame, target: int = 8) -> DataFrame:
    """At most ``target`` points: counts and values added up, participants averaged."""
    slots = F.when(F.col("_n") <= target, F.col("_i")).otherwise(
        F.expr(f"((_i + 1) * {target} - 1) div _n")
    )
    grouped = (
        _numbered(points)
        .withColumn("slot", slots)
        .groupBy("slot")
        .agg(
            F.max("bucket").alias("bucket"),
            F.sum("transaction_count").alias("transaction_count"),
            F.floor(F.sum("unique_addresses") / F.count("*") + 0.5).alias("unique_addresses"),
            F.max_by("avg_gas_price", "bucket").alias("avg_gas_price"),
            amount_text(F.sum(F.col("total_value").try_cast("decimal(38,0)"))).alias("total_value"),
        )
    )
    return grouped.drop("slot")


def bucket_deltas(points: DataFrame) -> DataFrame:
    """The latest bucket against the one before it."""
    order = Window.orderBy("bucket")
    latest = (
        points.withColumn("tx_before", F.lag("transaction_count").over(order))
        .withColumn("addresses_before", F.lag("unique_addresses").over(order))
        .orderBy(F.desc("bucket"))
        .limit(1)
    )
    return latest.select(
        "bucket",
        S.delta_percent(F.col("transaction_count"), F.col("tx_before")).alias("transaction_delta"),
        S.delta_percent(F.col("unique_addresses"), F.col("addresses_before")).alias("address_delta"),
    )


def _whole_number(text: str = "total_value"):
    return F.when(F.col(text).rlike(S.INTEGER_PATTERN), F.col(text).try_cast("decimal(38,0)"))


def network_totals(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("buckets"),
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        amount_text(F.sum(_whole_number())).alias("total_value"),
    )


def half_window_change(points: DataFrame) -> DataFrame:
    """Value moved in the later half of the series against the earlier half, in percent."""
    split = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    numbered = _numbered(points).withColumn("value", _whole_number()).withColumn("early", F.col("_i") < split)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = numbered.agg(
        F.coalesce(F.sum(F.when(F.col("early"), F.col("value"))), zero).alias("previous"),
        F.coalesce(F.sum(F.when(~F.col("early"), F.col("value"))), zero).alias("current"),
    )
    now, before = F.col("current"), F.col("previous")
    change = (now - before).cast("double") / before.cast("double") * 100
    return sums.select(
        before.cast("string").alias("previous_value"),
        now.cast("string").alias("current_value"),
        F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise(change).alias("value_change"),
    )


def flag_signal(recent_flags: DataFrame) -> DataFrame:
    """High-severity share of the latest flags."""
    counts = recent_flags.agg(
        F.count_if(F.col("severity") == "high").alias("high_count"), F.count("*").alias("flag_count")
    )
    others = F.greatest(F.col("flag_count") - F.col("high_count"), F.lit(0))
    return counts.select("high_count", "flag_count", S.delta_percent(F.col("high_count"), others).alias("signal_delta"))


def contract_queue_counts(recent_contracts: DataFrame) -> DataFrame:
    return recent_contracts.agg(
        F.count("*").alias("contracts"),
        F.count_if("flagged").alias("flagged_count"),
        F.count_if(F.col("bytecode_size") > 0).alias("with_bytecode_count"),
    )


def history_export(points: DataFrame) -> DataFrame:
    """The four columns of the history export."""
    return points.select("bucket", "transaction_count", "unique_addresses", "total_value")

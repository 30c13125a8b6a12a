"""Entity labels and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S


def address_risk(flags: DataFrame) -> DataFrame:
    """The gravest severity per flagged address."""
    return (
        flags.groupBy("address")
        .agg(F.max(S.severity_rank(F.col("severity"))).alias("rank"))
        .select("address", S.rank_label(F.col("rank")).alias("flag_risk"))
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("address").agg(
        F.count("*").alias("flag_count"),
        F.count_if(F.col("severity") == "high").alias("high_severity_flag_count"),
        S.rank_label(F.max(S.severity_rank(F.col("severity")))).alias("flag_risk"),
    )


def join_labels(df: DataFrame, entities: DataFrame, risk: DataFrame, address: str = "address") -> DataFrame:
    """Left-join label and flag-risk columns.

    No broadcast hint: label tables are usually small and Spark broadcasts them
    when their measured size allows it.
    """
    labels = entities.select(
        F.col("address").alias(address),
        F.col("name").alias("label_name"),
        F.col("entity_type").alias("label_type"),
        F.col("risk_level").alias("label_risk"),
        F.col("is_hub").alias("label_hub"),
        F.col("updated_at").alias("label_updated_at"),
    )
    risks = risk.select(F.col("address").alias(address), "flag_risk")
    return df.join(labels, address, "left").join(risks, address, "left")


def label_columns(is_contract: Column) -> list[Column]:
    """Name, type and label-first risk from the columns of ``join_labels``."""
    return [
        F.coalesce("label_name", F.lit("")).alias("entity_name"),
        S.entity_type_or_default(F.col("label_type"), is_contract).alias("entity_type"),
        S.risk_label_first(F.col("label_risk"), F.col("flag_risk")).alias("risk_level"),
    ]


def risk_by_label(accounts: DataFrame, entities: DataFrame, flags: DataFrame) -> DataFrame:
    joined = join_labels(accounts.select("address"), entities, address_risk(flags))
    return joined.select("address", S.risk_label_first(F.col("label_risk"), F.col("flag_risk")).alias("risk_level"))


def risk_by_flags(accounts: DataFrame, entities: DataFrame, flags: DataFrame) -> DataFrame:
    joined = join_labels(accounts.select("address"), entities, address_risk(flags))
    return joined.select("address", S.risk_flags_first(F.col("label_risk"), F.col("flag_risk")).alias("risk_level"))


def distinct_addresses(keys: DataFrame) -> DataFrame:
    """The different addresses of a list in normal form, blanks left out."""
    return keys.select(S.normalize_address(F.col("address")).alias("address")).filter(F.col("address") != "").distinct()


def entities_by_addresses(entities: DataFrame, keys: DataFrame) -> DataFrame:
    return entities.join(distinct_addresses(keys), "address", "left_semi")


def merge_seed_labels(existing: DataFrame, seeds: DataFrame, as_of) -> DataFrame:
    """Existing labels updated from a seed list; labels entered by hand stay as they are.

    ``written`` marks the rows that the seed inserted or changed.
    """
    seed = seeds.select(
        S.normalize_address(F.col("address")).alias("address"),
        F.struct("name", "entity_type", "risk_level", "is_hub").alias("seed"),
    ).filter(F.col("address") != "")
    kept = existing.select(
        "address",
        F.struct("name", "entity_type", "risk_level", "is_hub", "source", "updated_at").alias("old"),
    )
    by_hand = F.coalesce(F.col("old.source") == "manual", F.lit(False))
    written = F.col("seed").isNotNull() & ~by_hand
    both = kept.join(seed, "address", "full_outer").withColumn("written", written)
    fields = [
        F.when(F.col("written"), F.col(f"seed.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        for name in ("name", "entity_type", "risk_level", "is_hub")
    ]
    return both.select(
        "address",
        *fields,
        F.when(F.col("written"), "seed").otherwise(F.col("old.source")).alias("source"),
        F.when(F.col("written"), F.lit(as_of)).otherwise(F.col("old.updated_at")).alias("updated_at"),
        "written",
    )


def seed_accounts(seeds: DataFrame, accounts: DataFrame, as_of) -> DataFrame:
    """Accounts after seeding: seeded addresses exist, and contracts among them are marked."""
    fresh = seeds.select(
        S.normalize_address(F.col("address")).alias("address"), F.col("is_contract").alias("seed_contract")
    )
    both = accounts.join(fresh, "address", "full_outer")
    return both.select(
        "address",
        F.coalesce("balance", F.lit(0).cast("decimal(38,0)")).alias("balance"),
        (F.coalesce("is_contract", F.lit(False)) | F.coalesce("seed_contract", F.lit(False))).alias("is_contract"),
        F.coalesce("first_seen", F.lit(as_of)).alias("first_seen"),
        F.coalesce("last_seen", F.lit(as_of)).alias("last_seen"),
    )

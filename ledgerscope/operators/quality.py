"""Rules that the stored tables must satisfy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ["low", "medium", "high"]
JOB_STATES = ["pending", "processing", "done"]
RISK_LEVELS = ["none", "low", "medium", "high"]


def _outside(df: DataFrame, column: str, allowed: list[str], rule: str) -> DataFrame:
    return df.agg(F.count_if(~F.col(column).isin(allowed)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Rows beyond the first of each complete key."""
    groups = df.dropna(subset=keys).groupBy(*keys).agg((F.count("*") - 1).alias("extra"))
    return groups.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _orphans(df: DataFrame, key: str, known: DataFrame, rule: str) -> DataFrame:
    lost = df.filter(F.col(key).isNotNull()).join(known.select(F.col("address").alias(key)), key, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def constraint_violations(
    transactions: DataFrame, accounts: DataFrame, flags: DataFrame, entities: DataFrame, jobs: DataFrame
) -> DataFrame:
    """How many rows break each rule; all zero for a sound ledger."""
    checks = [
        _outside(flags, "severity", SEVERITIES, "flag severity"),
        _outside(jobs, "status", JOB_STATES, "job status"),
        _outside(entities, "risk_level", RISK_LEVELS, "label risk"),
        _repeated(flags, ["tx_hash", "address", "flag_type"], "unique signal"),
        _repeated(accounts, ["address"], "unique account"),
        _repeated(transactions, ["hash"], "unique transaction"),
        _orphans(transactions, "from_address", accounts, "known sender"),
        _orphans(transactions, "to_address", accounts, "known recipient"),
    ]
    return reduce(DataFrame.unionByName, checks)

"""Participation rows: who took part in which transaction, and on which side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touches(transactions: DataFrame, *keep: str) -> DataFrame:
    """One 'out' row per sender and one 'in' row per recipient, from a single scan.

    A transfer to oneself yields both rows; a contract creation only the first.
    """
    sides = F.array(
        F.struct(
            F.lit("out").alias("direction"), F.col("from_address").alias("address"), F.col("to_address").alias("counterparty")
        ),
        F.struct(
            F.lit("in").alias("direction"), F.col("to_address").alias("address"), F.col("from_address").alias("counterparty")
        ),
    )
    return transactions.select(*keep, F.inline(sides)).filter(F.col("address").isNotNull())


def distinct_touches(transactions: DataFrame, *keep: str) -> DataFrame:
    """Like ``touches``, but a transfer to oneself counts once, as 'out'."""
    rows = touches(transactions, *keep)
    own = F.col("counterparty").eqNullSafe(F.col("address"))
    return rows.filter(~((F.col("direction") == "in") & own))

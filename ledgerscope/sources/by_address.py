"""A copy of the ledger clustered by address, so that a few addresses read a few files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.touches import distinct_touches

# Everything but the payload, of which only the size is kept.
KEPT = ["hash", "from_address", "to_address", "value", "gas", "gas_price", "nonce", "block_number", "payload", "timestamp"]
SLOTS = 256


def slot_of(address: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class AddressIndex:
    """Transactions under each of their addresses: one folder per slot (a hash of the address), files sorted by address."""

    spark: SparkSession
    root: str
    slots: int = SLOTS

    def write(self, transactions: DataFrame) -> None:
        """Each transaction is written once for its sender and once for its recipient.

        Ranges of slot, address and time are written, so that a hub is spread
        over several files instead of filling one.
        """
        sized = transactions.withColumn("payload", S.octets(F.col("data"))).withColumn("tx", F.struct(*KEPT))
        rows = distinct_touches(sized, "tx").select("address", "tx.*", slot_of(F.col("address"), self.slots).alias("slot"))
        ranges = rows.repartitionByRange("slot", "address", "timestamp").sortWithinPartitions("slot", "address", "timestamp")
        ranges.write.mode("overwrite").partitionBy("slot").parquet(self.root)

    def transactions(self, addresses: Iterable[str]) -> DataFrame:
        """All transactions of the addresses, each once, with ``payload`` (size) in place of the payload.

        The slots are literals, so other folders are not listed for reading, and
        the addresses reach the Parquet scan.
        """
        wanted = sorted(set(addresses))
        keys = self.spark.createDataFrame([(a,) for a in wanted], "address string")
        slots = sorted(r[0] for r in keys.select(slot_of(F.col("address"), self.slots)).distinct().collect())
        rows = self.spark.read.parquet(self.root).filter(F.col("slot").isin(slots) & F.col("address").isin(wanted))
        # A transaction between two of the addresses stands under both.
        under_sender = F.col("address") == F.col("from_address")
        return rows.filter(under_sender | ~F.col("from_address").isin(wanted)).select(*KEPT)


def touching(transactions: DataFrame, addresses: Iterable[str]) -> DataFrame:
    """The same from the ledger itself: one scan with a filter, nothing is shuffled."""
    wanted = sorted(set(addresses))
    found = transactions.filter(F.col("from_address").isin(wanted) | F.col("to_address").isin(wanted))
    return found.withColumn("payload", S.octets(F.col("data"))).select(*KEPT)

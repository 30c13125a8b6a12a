"""The ledger: the base tables every operator reads."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import schemas
from ledgerscope.operators import accounts as _accounts
from ledgerscope.session import materialize
from ledgerscope.sources.by_address import AddressIndex, touching


@dataclass
class Ledger:
    """Base tables plus the reference time of a run.

    ``bytecode`` holds one row per contract address; ``has_code`` tells empty code
    apart without reading the code. ``run_time`` stands for "now"; left out, it is
    the latest transaction time. ``by_address`` is a copy of the transactions for
    lookups of a few addresses.
    """

    transactions: DataFrame
    bytecode: DataFrame
    metadata: DataFrame
    entities: DataFrame
    flags: DataFrame
    jobs: DataFrame
    run_time: datetime | None = None
    by_address: AddressIndex | None = None

    @property
    def spark(self) -> SparkSession:
        return self.transactions.sparkSession

    @cached_property
    def as_of(self) -> datetime | None:
        """One value, read once, so that time filters reach the scan as literals."""
        if self.run_time is not None:
            return self.run_time
        return self.transactions.agg(F.max("timestamp")).first()[0]

    @cached_property
    def accounts(self) -> DataFrame:
        return self.account_activity.select(*_accounts.ACCOUNT)

    @cached_property
    def account_activity(self) -> DataFrame:
        return _accounts.account_activity(self.transactions, self.bytecode)

    def with_stored_accounts(self) -> Ledger:
        """The same ledger with its account dimension written once.

        For compositions that look accounts up several times: the dimension is far
        smaller than the transactions it would otherwise be derived from each time.
        """
        stored = replace(self, run_time=self.as_of)
        stored.account_activity = materialize(self.account_activity, "accounts")
        return stored


    def around(self, addresses: list[str]) -> Ledger:
        """The part that holds everything about a few addresses: their transactions, code, metadata, labels and flags.

        What is worked out for one of them is as in the whole ledger; transactions
        have the size of the payload (``payload``) in place of the payload.
        """
        wanted = sorted(set(addresses))
        own = self.by_address.transactions(wanted) if self.by_address else touching(self.transactions, wanted)
        parts = {name: getattr(self, name).filter(F.col("address").isin(wanted)) for name in ("bytecode", "metadata", "entities", "flags")}
        return replace(self, transactions=own, by_address=None, **parts)


def read_ledger(spark: SparkSession, root: str, run_time: datetime | None = None) -> Ledger:
    """Read a ledger stored as one Parquet folder per table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {
        "transactions": schemas.TRANSACTIONS,
        "bytecode": schemas.BYTECODE,
        "metadata": schemas.METADATA,
        "entities": schemas.ENTITIES,
        "flags": schemas.FLAGS,
        "jobs": schemas.JOBS,
    }
    frames = {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in tables.items()}
    return Ledger(run_time=run_time, **frames)


def write_ledger(ledger: Ledger, root: str) -> None:
    """Store the base tables, transactions in order of time.

    Every file then covers a short span of time, and time filters skip the others
    by their statistics.
    """
    for name in ("bytecode", "metadata", "entities", "flags", "jobs"):
        getattr(ledger, name).write.mode("overwrite").parquet(f"{root}/{name}")
    ordered = ledger.transactions.repartitionByRange("timestamp").sortWithinPartitions("timestamp")
    ordered.write.mode("overwrite").parquet(f"{root}/transactions")

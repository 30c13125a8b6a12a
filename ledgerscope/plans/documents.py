"""Documents composed from several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.functions.explanations import COLUMNS, explain_flags
from ledgerscope.operators import accounts as A
from ledgerscope.operators import records as R
from ledgerscope.operators import series as TS
from ledgerscope.operators.labels import address_risk, flag_counts, join_labels, label_columns
from ledgerscope.session import materialize
from ledgerscope.sources.ledger import Ledger


def labelled_counterparties(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """Top counterparties per address with labels; only the listed ones are looked up."""
    top = A.counterparties(ledger.transactions, limit)
    contracts = ledger.accounts.select(F.col("address").alias("counterparty"), "is_contract")
    joined = join_labels(
        top.join(contracts, "counterparty", "left"), ledger.entities, address_risk(ledger.flags), "counterparty"
    )
    contract = F.coalesce("is_contract", F.lit(False))
    return joined.select(
        "address",
        "counterparty",
        "position",
        *label_columns(contract),
        contract.alias("is_contract"),
        "sent_count",
        "received_count",
        "total_count",
        A.amount_text(F.col("total_value")).alias("total_value"),
        "last_seen",
    )


def counterparty_total(ledger: Ledger) -> DataFrame:
    """Value moved with the listed counterparties, per address."""
    return (
        A.counterparties(ledger.transactions)
        .groupBy("address")
        .agg(A.amount_text(F.sum("total_value")).alias("total_value"))
    )


def profile_summary(ledger: Ledger) -> DataFrame:
    """The flat part of an account profile, for every account."""
    flagged = flag_counts(ledger.flags)
    joined = join_labels(
        ledger.account_activity.join(flagged.drop("flag_risk"), "address", "left"),
        ledger.entities,
        flagged.select("address", "flag_risk"),
    )
    zero = F.lit(0)
    return joined.select(
        "address",
        F.col("balance").cast("string").alias("balance"),
        "is_contract",
        "first_seen",
        "last_seen",
        *A.ACTIVITY,
        F.coalesce("flag_count", zero).alias("flag_count"),
        F.coalesce("high_severity_flag_count", zero).alias("high_severity_flag_count"),
        *label_columns(F.col("is_contract")),
        F.coalesce("label_hub", F.lit(False)).alias("is_hub"),
    )


def account_profiles(ledger: Ledger, limit: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Account profiles with their counterparty and transaction lists (at most ``limit`` entries each).

    With ``keys`` only of these addresses, from the part of the ledger around
    them and their listed counterparties; what it costs does not grow with
    the ledger where that has a copy by address. Unknown addresses give no row.
    """
    if keys is not None:
        wanted = _addresses(ledger, keys)
        partners = A.counterparties(ledger.around(wanted).transactions, limit).filter(F.col("address").isin(wanted))
        # At most ``limit`` for each key.
        listed = [r[0] for r in partners.select("counterparty").distinct().collect()]
        profiles = account_profiles(ledger.around([*wanted, *listed]), limit)
        return profiles.filter(F.col("address").isin(wanted))
    ledger = ledger.with_stored_accounts()
    partners = (
        labelled_counterparties(ledger, limit)
        .groupBy("address")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position",
                        "counterparty",
                        "entity_name",
                        "entity_type",
                        "risk_level",
                        "is_contract",
                        "sent_count",
                        "received_count",
                        "total_count",
                        "total_value",
                        "last_seen",
                    )
                )
            ).alias("counterparties")
        )
    )
    recent = (
        A.recent_for_accounts(ledger.transactions, limit, "from_address", "to_address", "value", "gas", "gas_price")
        .groupBy("address")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", "hash", "from_address", "to_address", "value", "gas", "gas_price", "timestamp"))
            ).alias("recent_transactions")
        )
    )
    return profile_summary(ledger).join(partners, "address", "left").join(recent, "address", "left")


def _addresses(ledger: Ledger, keys: list[str]) -> list[str]:
    """The keys as the ledger writes addresses."""
    rows = ledger.spark.createDataFrame([(k,) for k in keys], "address string")
    return sorted({r[0] for r in rows.select(S.normalize_address(F.col("address"))).collect() if r[0]})


def contract_details(ledger: Ledger, contracts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The dossier of every contract account, or of those among ``keys``. ``contracts`` holds code and flagged marks."""
    if keys is not None:
        wanted = _addresses(ledger, keys)
        ledger, contracts = ledger.around(wanted), contracts.filter(F.col("address").isin(wanted))
    risk = address_risk(ledger.flags)
    known = join_labels(ledger.accounts.filter("is_contract"), ledger.entities, risk)
    joined = known.join(contracts.select("address", "bytecode", "flagged"), "address", "left").join(
        ledger.metadata, "address", "left"
    )
    blank = F.lit("")
    return joined.select(
        "address",
        *label_columns(F.lit(True)),
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        S.octets(F.col("bytecode")).alias("bytecode_size"),
        S.bytes_to_hex(F.col("bytecode")).alias("bytecode"),
        "first_seen",
        "last_seen",
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce("compiler_version", blank).alias("compiler_version"),
        "abi",
        F.coalesce("source_code", blank).alias("source_code"),
        F.coalesce("decompiled_code", blank).alias("decompiled_code"),
    )


def transaction_details(ledger: Ledger, keys: list[str] | None = None) -> DataFrame:
    """Every transaction, or those whose hash is among ``keys``, with payload, flag summary, and the risk of both parties."""
    flags, transactions = explain_flags(ledger.flags), ledger.transactions
    if keys is not None:
        flags = flags.filter(F.col("tx_hash").isin(keys))
        transactions = materialize(transactions.filter(F.col("hash").isin(keys)), "transactions")
        # At most two for each key.
        ends = transactions.select(F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
        ledger = ledger.around([r[0] for r in ends.collect() if r[0]])
    per_tx = flags.groupBy(F.col("tx_hash").alias("hash")).agg(
        F.count("*").alias("flag_count"),
        F.max_by(F.struct("flag_type", "severity", *COLUMNS), F.struct("detected_at", "id")).alias("latest"),
    )
    profiles = profile_summary(ledger).select("address", "entity_name", "risk_level", "total_count")
    profiles = materialize(profiles, "profiles")  # joined twice
    sender = profiles.select([F.col(c).alias(f"from_{c}") for c in profiles.columns])
    recipient = profiles.select([F.col(c).alias(f"to_{c}") for c in profiles.columns])
    tx = transactions.select("hash", "from_address", "to_address", "value", "timestamp")
    sent = tx.join(sender, "from_address", "left")
    # Creations have no recipient to look up; as one null key they would meet in one task.
    called = sent.filter(F.col("to_address").isNotNull()).join(recipient, "to_address", "left")
    nobody = [F.lit(None).cast(recipient.schema[c].dataType).alias(c) for c in recipient.columns if c != "to_address"]
    created = sent.filter(F.col("to_address").isNull()).select("*", *nobody)
    # The payload joins last, so that it is moved once.
    payload = transactions.select("hash", "data")
    return (
        called.unionByName(created)
        .join(per_tx, "hash", "left")
        .join(payload, "hash")
        .select(
            "hash",
            "from_address",
            "to_address",
            F.col("value").cast("string").alias("value"),
            "timestamp",
            S.bytes_to_hex(F.col("data")).alias("payload"),
            F.col("to_address").isNull().alias("is_creation"),
            F.coalesce("flag_count", F.lit(0)).alias("flag_count"),
            F.col("latest.flag_type").alias("latest_flag_type"),
            F.col("latest.next_action").alias("latest_next_action"),
            "from_entity_name",
            "from_risk_level",
            "from_total_count",
            "to_entity_name",
            "to_risk_level",
            "to_total_count",
        )
    )


def _listed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A short, limited list folded into one array column, in the given order."""
    keys = F.struct(*[key.alias(f"k{i}") for i, key in enumerate(order)])
    entries = F.array_sort(F.collect_list(F.struct(keys.alias("order"), F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.transform(entries, lambda e: e["row"]).alias(name))


def _as_json(document: Column) -> Column:
    return F.to_json(document, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})


def _recent(ledger: Ledger, limit: int) -> DataFrame:
    """Latest transactions with amounts as text: JSON numbers would lose digits."""
    rows = R.recent_transactions(ledger.transactions, limit)
    return rows.withColumns({name: F.col(name).cast("string") for name in ("value", "gas_price")})


def _newest(column: str) -> Column:
    return -F.unix_micros(column)


def snapshot(ledger: Ledger, transactions: int = 10, flags: int = 10) -> DataFrame:
    """The live snapshot as one JSON document per run."""
    recent = _recent(ledger, transactions)
    raised = explain_flags(R.recent_flags(ledger.flags, flags))
    overview = TS.overview_stats(ledger.transactions, ledger.accounts, ledger.flags, ledger.jobs)
    parts = [
        overview.select(F.struct("*").alias("overview")),
        TS.enrichment_status(ledger.jobs).select(F.struct("*").alias("enrichment")),
        _listed(recent, [_newest("timestamp"), F.col("hash")], "recent_transactions"),
        _listed(raised, [_newest("detected_at"), -F.col("id")], "recent_flags"),
    ]
    row = TS.first_of_each(parts)
    return row.select(_as_json(F.struct(F.lit(ledger.as_of).alias("timestamp"), *row.columns)).alias("snapshot"))


def overview_page(ledger: Ledger) -> DataFrame:
    """The overview: counters, six busiest addresses, eight transactions, six flags, 24 hours of metrics."""
    ledger = ledger.with_stored_accounts()
    top = A.top_addresses(ledger.account_activity, 6)
    recent = _recent(ledger, 8)
    raised = explain_flags(R.recent_flags(ledger.flags, 6))
    metrics = TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 24)
    parts = [
        TS.overview_stats(ledger.transactions, ledger.accounts, ledger.flags, ledger.jobs).select(
            F.struct("*").alias("overview")
        ),
        _listed(top, [-F.col("total_count"), _newest("last_seen"), F.col("address")], "top_addresses"),
        _listed(recent, [_newest("timestamp"), F.col("hash")], "recent_transactions"),
        _listed(raised, [_newest("detected_at"), -F.col("id")], "recent_flags"),
        _listed(metrics, [F.col("bucket")], "network_metrics"),
    ]
    row = TS.first_of_each(parts)
    return row.select(_as_json(F.struct(*row.columns)).alias("page"))

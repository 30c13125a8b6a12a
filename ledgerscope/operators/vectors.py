"""Fingerprints, behaviour profiles and exact nearest neighbours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.functions.fingerprint import bytecode_embedding
from ledgerscope.operators.accounts import is_in, is_out
from ledgerscope.operators.knn import nearest_neighbours
from ledgerscope.operators.labels import address_risk, join_labels, label_columns
from ledgerscope.operators.touches import distinct_touches, touches
from ledgerscope.schemas import EMBEDDING_DIMS, STORED_BEHAVIOR
from ledgerscope.session import materialize
from ledgerscope.streaming.store import VersionedTable

# Behaviour features in embedding order, with the words used in highlights.
FEATURES = {
    "sent_count_log": "activity volume",
    "received_count_log": "incoming volume",
    "send_receive_balance": "send/receive balance",
    "avg_sent_value_log": "transfer size",
    "avg_gas_price_log": "gas price posture",
    "counterparty_diversity": "counterparty spread",
    "contract_call_ratio": "contract-call ratio",
    "recent_burst_ratio": "recent burstiness",
    "night_ratio": "overnight activity",
    "weekend_ratio": "weekend activity",
    "active_span_log": "activity span",
}
HIGHLIGHTS = 3


def latest_bytecode(observations: DataFrame) -> DataFrame:
    """The last observed code per address; empty code is ignored."""
    return (
        observations.filter(S.octets(F.col("bytecode")) > 0)
        .groupBy("address")
        .agg(F.max_by("bytecode", F.struct("observed_at", "bytecode")).alias("bytecode"))
    )


def contract_vectors(bytecode: DataFrame) -> DataFrame:
    """Stored contracts: code, fingerprint, not flagged yet."""
    return bytecode.filter("has_code").select(
        "address", "bytecode", bytecode_embedding(F.col("bytecode")).alias("embedding"), F.lit(False).alias("flagged")
    )


def similar_contracts(contracts: DataFrame, limit: int | None = None, max_distance: float | None = None) -> DataFrame:
    """The nearest other contracts of every stored contract."""
    n = S.clamp_limit(limit, 10, 50)
    vectors = contracts.select(F.col("address").alias("id"), F.col("embedding").alias("vector"))
    found = nearest_neighbours(vectors, None, n, max_distance)
    flagged = contracts.select(F.col("address").alias("match"), "flagged")
    return found.select(
        F.col("id").alias("address"), F.col("neighbour").alias("match"), "similarity", "position"
    ).join(flagged, "match")


def nearest_stored(asked: DataFrame, stored: DataFrame, max_distance: float) -> DataFrame:
    """The nearest other stored contract for some of the stored contracts."""
    queries = asked.select(F.col("address").alias("id"), F.col("embedding").alias("vector"))
    pool = stored.select(F.col("address").alias("id"), F.col("embedding").alias("vector"))
    found = nearest_neighbours(queries, pool, 1, max_distance)
    return found.select(F.col("id").alias("address"), F.col("neighbour").alias("match"), "similarity")


def similar_bytecode(samples: DataFrame, contracts: DataFrame, limit: int | None = None) -> DataFrame:
    """The nearest stored contracts for code that need not be stored itself."""
    n = S.clamp_limit(limit, 10)
    queries = samples.filter(S.octets(F.col("bytecode")) > 0).select(
        F.col("address").alias("id"), bytecode_embedding(F.col("bytecode")).alias("vector")
    )
    pool = contracts.select(F.col("address").alias("id"), F.col("embedding").alias("vector"))
    found = nearest_neighbours(queries, pool, n)
    flagged = contracts.select(F.col("address").alias("match"), "flagged")
    return found.select(
        F.col("id").alias("address"), F.col("neighbour").alias("match"), "similarity", "position"
    ).join(flagged, "match")


# ---------------------------------------------------------------- behaviour


def behavior_stats(transactions: DataFrame, as_of) -> DataFrame:
    """Twelve measures per participating address; a transfer to oneself counts once, as sent."""
    sized = transactions.withColumn("payload", S.octets(F.col("data")))
    rows = distinct_touches(sized, "value", "gas_price", "payload", "timestamp")

    def share(condition: Column) -> Column:
        return F.count_if(condition).cast("double") / F.count("*")

    def mean_sent(name: str) -> Column:
        # Exact decimal sums, divided once at the end.
        total = F.sum(F.when(is_out(), F.col(name))).cast("double")
        count = F.count(F.when(is_out(), F.col(name)))
        return F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0))

    since = lambda hours: F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")
    micros = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return rows.groupBy("address").agg(
        F.count_if(is_out()).alias("sent_count"),
        F.count_if(is_in()).alias("received_count"),
        mean_sent("value").alias("avg_sent_value"),
        mean_sent("gas_price").alias("avg_gas_price"),
        F.count_distinct("counterparty").alias("unique_counterparties"),
        share(is_out() & (F.col("payload") > 0)).alias("contract_call_ratio"),
        F.count_if(since(1)).alias("recent_one_hour"),
        F.count_if(since(24)).alias("recent_twenty_four_hours"),
        share(F.hour("timestamp") <= 5).alias("night_ratio"),
        share(F.dayofweek("timestamp").isin(1, 7)).alias("weekend_ratio"),
        F.coalesce(micros.cast("double") / 3.6e9, F.lit(0.0)).alias("active_span_hours"),
    )


def behavior_features(stats: DataFrame) -> DataFrame:
    """The eleven features and the number of transactions they rest on."""
    sent, received = F.col("sent_count"), F.col("received_count")
    total = sent + received
    recent = F.col("recent_twenty_four_hours")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)

    return stats.select(
        "address",
        total.alias("sample_size"),
        F.log1p(sent).alias("sent_count_log"),
        F.log1p(received).alias("received_count_log"),
        ratio(sent - received, total).alias("send_receive_balance"),
        F.log10(F.col("avg_sent_value") + 1).alias("avg_sent_value_log"),
        F.log10(F.col("avg_gas_price") + 1).alias("avg_gas_price_log"),
        ratio(F.col("unique_counterparties"), total).alias("counterparty_diversity"),
        "contract_call_ratio",
        ratio(F.col("recent_one_hour"), recent).alias("recent_burst_ratio"),
        "night_ratio",
        "weekend_ratio",
        F.log1p("active_span_hours").alias("active_span_log"),
    )


def complete_features(features: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add accounts that never took part, with all features zero."""
    joined = accounts.select("address").join(features, "address", "left")
    return joined.fillna(0, ["sample_size"]).fillna(0.0, list(FEATURES))


def feature_map() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURES]), F.array(*[F.col(n) for n in FEATURES]))


def with_embedding(features: DataFrame) -> DataFrame:
    """Add the features as the first slots of a unit vector, kept to six decimals."""
    squares = F.aggregate("_values", F.lit(0.0), lambda total, v: total + v * v)
    scaled = F.transform(
        "_values", lambda v: F.round(F.when(F.col("_length") > 0, v / F.col("_length")).otherwise(0.0), 6).cast("float")
    )
    unused = F.array_repeat(F.lit(0.0).cast("float"), EMBEDDING_DIMS - len(FEATURES))
    return (
        features.withColumn("_values", F.array(*FEATURES))
        .withColumn("_length", F.sqrt(squares))
        .withColumn("embedding", F.concat(scaled, unused))
        .drop("_values", "_length")
    )


def behavior_store(spark: SparkSession, root: str) -> VersionedTable:
    """Stored behaviour vectors, one for each address; newer ones replace older ones."""
    return VersionedTable(spark, root, STORED_BEHAVIOR, ("address",))


def upsert_behavior(stored: VersionedTable, transactions: DataFrame, as_of, since: datetime | None = None) -> int:
    """Store the vectors of all accounts that took part, with ``since`` only of those that did later than that.

    A vector describes all transactions of its account, so those of the accounts
    in question are read whole.
    """
    if since is not None:
        moved = touches(transactions.filter(F.col("timestamp") > F.lit(since)), "hash").select("address").distinct()
        moved = materialize(moved, "moved")
        stats = behavior_stats(transactions, as_of).join(moved, "address", "left_semi")
    else:
        stats = behavior_stats(transactions, as_of)
    return stored.upsert(with_embedding(behavior_features(stats)))


def behavior_profiles(features: DataFrame, accounts: DataFrame, entities: DataFrame, flags: DataFrame) -> DataFrame:
    """Features with labels, one row per account."""
    known = join_labels(accounts.select("address", "is_contract"), entities, address_risk(flags))
    return (
        complete_features(features, accounts)
        .join(known, "address")
        .select("address", "is_contract", *label_columns(F.col("is_contract")), feature_map().alias("features"), "sample_size")
    )


def highlights(source: Column, target: Column) -> Column:
    """The three features that differ least; ties keep feature order."""
    deltas = F.array(
        *[
            F.struct(F.abs(source[name] - target[name]).alias("diff"), F.lit(i).alias("rank"), F.lit(f"similar {words}").alias("text"))
            for i, (name, words) in enumerate(FEATURES.items())
        ]
    )
    return F.transform(F.slice(F.array_sort(deltas), 1, HIGHLIGHTS), lambda d: d["text"])


def similar_accounts(
    features: DataFrame,
    accounts: DataFrame,
    entities: DataFrame,
    flags: DataFrame,
    limit: int | None = None,
    pool: DataFrame | None = None,
) -> DataFrame:
    """The accounts that behave most alike, for every account.

    ``pool`` restricts the accounts to choose from, for instance to the most active
    ones; without it all accounts are compared with all.
    """
    n = S.clamp_limit(limit, 8, 25)
    # Read several times below: written once, not derived from the ledger each time.
    all_features = materialize(complete_features(features, accounts), "behavior")
    # The unused slots are zero in every vector and do not change a cosine.
    used = F.slice("embedding", 1, len(FEATURES))
    vectors = with_embedding(all_features).select(F.col("address").alias("id"), used.alias("vector"))
    chosen = None
    if pool is not None:
        chosen = vectors.join(pool.select(F.col("address").alias("id")), "id", "left_semi")
    found = nearest_neighbours(vectors, chosen, n)
    values = F.struct(*FEATURES)
    own = all_features.select(F.col("address").alias("id"), values.alias("own"))
    known = join_labels(accounts.select("address", "is_contract"), entities, address_risk(flags))
    others = (
        all_features.join(known, "address")
        .select(
            F.col("address").alias("neighbour"),
            values.alias("other"),
            "is_contract",
            *label_columns(F.col("is_contract")),
        )
    )
    return (
        found.join(own, "id")
        .join(others, "neighbour")
        .select(
            F.col("id").alias("address"),
            F.col("neighbour").alias("match"),
            "position",
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))).alias("similarity"),
            "entity_name",
            "entity_type",
            "risk_level",
            "is_contract",
            highlights(F.col("own"), F.col("other")).alias("highlights"),
        )
    )


def top_features(features: DataFrame, count: int = 5) -> DataFrame:
    """Per account the features with the largest absolute value, as displayed."""
    entries = F.array(
        *[
            F.struct((-F.abs(F.col(n))).alias("weight"), F.lit(i).alias("rank"), F.lit(n).alias("name"), F.col(n).alias("value"))
            for i, n in enumerate(FEATURES)
        ]
    )
    top = F.slice(F.array_sort(entries), 1, count)
    return features.select("address", F.posexplode(top).alias("position", "entry")).select(
        "address",
        (F.col("position") + 1).alias("position"),
        F.col("entry.name").alias("feature"),
        S.feature_title(F.col("entry.name")).alias("label"),
        F.col("entry.value").alias("value"),
    )

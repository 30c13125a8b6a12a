"""Detectors that raise flags."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.paths import BY_TIME, WalkSearch, collapse_pairs, edges_in_reach
from ledgerscope.operators.records import circular_candidates, contract_calls
from ledgerscope.operators.touches import touches
from ledgerscope.session import materialize

# Fixed values.
MAX_RETURN_HOPS = 3
SIMILAR_BYTECODE_THRESHOLD = 0.98
# The same bound as a distance between unit vectors.
SIMILAR_DISTANCE = (2 - 2 * SIMILAR_BYTECODE_THRESHOLD) ** 0.5
# Types of labelled entities whose partners are worth a look.
MONITORED_TYPES = ("bridge", "exchange", "hub", "mixer")


def earliest_returns(edges: DataFrame, transfers: DataFrame) -> DataFrame:
    """Per (from, to) and hop count, the return path that was complete first.

    ``closed_at`` is the time of its latest edge. Hop count h + 1 is searched only
    for pairs with a transfer older than every shorter return, and results later
    than all transfers of the pair are dropped.
    """
    graph = collapse_pairs(edges, BY_TIME)
    requests = transfers.groupBy(F.col("to_address").alias("src"), F.col("from_address").alias("dst")).agg(
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )
    open_requests = materialize(requests, "return-requests")
    search = WalkSearch(graph, MAX_RETURN_HOPS)
    found = None
    for hops in range(1, MAX_RETURN_HOPS + 1):
        walks = search.next(open_requests.select("src", "dst"))
        closed = walks.select("src", "dst", F.lit(hops).alias("hops"), F.col("times")[0].alias("closed_at"), "path")
        closed = open_requests.join(closed, ["src", "dst"]).filter("closed_at <= last_at")
        closed = materialize(closed.drop("last_at"), f"returns{hops}")
        found = closed if found is None else found.unionByName(closed)
        settled = closed.filter("closed_at <= first_at").select("src", "dst")
        open_requests = open_requests.join(settled, ["src", "dst"], "left_anti")
    return found.drop("first_at")


def detect_circular(history: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Flags for plain transfers whose amount can already flow back to the sender.

    ``history`` holds all transactions up to and including the candidates. A path
    counts for a transfer at time t only if all its edges were there at t.
    """
    plain = circular_candidates(history if candidates is None else candidates)
    edges = history.filter(F.col("to_address").isNotNull()).select("from_address", "to_address", "timestamp")
    if candidates is not None:
        requests = plain.select(F.col("to_address").alias("src"), F.col("from_address").alias("dst"))
        edges = edges_in_reach(edges, requests, MAX_RETURN_HOPS)
    returns = earliest_returns(edges, plain).select(
        F.col("dst").alias("from_address"), F.col("src").alias("to_address"), "hops", "closed_at", "path"
    )
    # At most three rows per pair: the first closing time for each hop count.
    choices = returns.groupBy("from_address", "to_address").agg(
        F.array_sort(F.collect_list(F.struct("hops", "closed_at", "path"))).alias("choices")
    )
    flagged = (
        plain.select("hash", "from_address", "to_address", "timestamp")
        .join(choices, ["from_address", "to_address"])
        .withColumn("flow", F.get(F.filter("choices", lambda c: c["closed_at"] <= F.col("timestamp")), F.lit(0)))
        .filter(F.col("flow").isNotNull())
    )
    hops = F.col("flow.hops")
    return flagged.select(
        F.col("hash").alias("tx_hash"),
        F.col("from_address").alias("address"),
        F.lit("circular_flow").alias("flag_type"),
        S.circular_severity(hops).alias("severity"),
        F.format_string(
            "Detected a %d-hop return path from %s back to %s: %s",
            hops,
            "to_address",
            "from_address",
            F.array_join("flow.path", " -> "),
        ).alias("description"),
        F.col("timestamp").alias("detected_at"),
        hops.alias("hops"),
    )


def detect_similar_bytecode(transactions: DataFrame, bytecode: DataFrame, nearest: DataFrame) -> DataFrame:
    """Flags for calls of contracts whose nearest other contract is at least 0.98 similar.

    ``nearest`` has one row per contract: address, match, similarity.
    """
    near = nearest.filter(F.col("similarity") >= SIMILAR_BYTECODE_THRESHOLD).select(
        F.col("address").alias("to_address"), "match", "similarity"
    )
    calls = contract_calls(transactions, bytecode).select("hash", "to_address", "timestamp")
    return calls.join(near, "to_address").select(
        F.col("hash").alias("tx_hash"),
        F.col("to_address").alias("address"),
        F.lit("similar_bytecode").alias("flag_type"),
        S.bytecode_severity(F.col("similarity")).alias("severity"),
        F.format_string(
            "Contract %s is %.2f similar to %s based on pgvector bytecode fingerprints", "to_address", "similarity", "match"
        ).alias("description"),
        F.col("timestamp").alias("detected_at"),
        "similarity",
    )


def detect_velocity(
    transactions: DataFrame, *, ratio: float, minimum: int, baseline_hours: int = 24, since: datetime | None = None
) -> DataFrame:
    """Flags for hours in which an address was far more active than in the hours before.

    An hour counts if it has at least ``minimum`` participations and more than
    ``ratio`` times the mean of the ``baseline_hours`` hours before it, of which
    those without any count as zero; silence is thus a baseline of zero. One row
    for each address and hour, naming the hour's latest transaction.

    Addresses are first reduced to one row an hour, so a hub with a large part of
    the ledger costs as many rows as it has active hours; the baseline is a range
    over event time, so empty hours are never generated. With ``since`` only
    hours from then on are judged, and older rows than their baselines need are
    not read.
    """
    if since is not None:
        start = since.replace(minute=0, second=0, microsecond=0)
        transactions = transactions.filter(F.col("timestamp") >= F.lit(start - timedelta(hours=baseline_hours)))
    latest = F.max(F.struct("timestamp", "hash"))
    hours = (
        touches(transactions.filter(F.col("timestamp").isNotNull()), "hash", "timestamp")
        .groupBy("address", F.date_trunc("hour", "timestamp").alias("bucket"))
        .agg(F.count("*").alias("total_count"), latest.alias("last"))
    )
    before = (
        Window.partitionBy("address").orderBy(F.unix_timestamp("bucket")).rangeBetween(-3600 * baseline_hours, -1)
    )
    judged = hours.withColumn("baseline_count", F.coalesce(F.sum("total_count").over(before), F.lit(0)))
    if since is not None:
        judged = judged.filter(F.col("bucket") >= F.lit(start))
    spikes = judged.filter(
        (F.col("total_count") >= minimum) & (F.col("total_count") * baseline_hours > F.col("baseline_count") * ratio)
    )
    return spikes.select(
        F.col("last.hash").alias("tx_hash"),
        "address",
        F.lit("velocity_spike").alias("flag_type"),
        F.lit("medium").alias("severity"),
        F.format_string(
            f"%d transactions within an hour after %d in the {baseline_hours} hours before", "total_count", "baseline_count"
        ).alias("description"),
        F.col("last.timestamp").alias("detected_at"),
        "bucket",
        "total_count",
        "baseline_count",
    )


def detect_high_value(transactions: DataFrame, *, threshold: int, since: datetime | None = None) -> DataFrame:
    """Flags for transfers of at least ``threshold``; a filter on the scan, nothing is shuffled."""
    if since is not None:
        transactions = transactions.filter(F.col("timestamp") >= F.lit(since))
    large = transactions.filter(F.col("value") >= F.lit(threshold).cast("decimal(38,0)"))
    return large.select(
        F.col("hash").alias("tx_hash"),
        F.col("from_address").alias("address"),
        F.lit("high_value_transfer").alias("flag_type"),
        F.lit("low").alias("severity"),
        F.format_string(f"Transfer of %s wei reaches the threshold of {threshold}", F.col("value").cast("string")).alias("description"),
        F.col("timestamp").alias("detected_at"),
        "value",
    )


def monitored_nodes(
    transactions: DataFrame, entities: DataFrame, min_degree: int, parts: int, types: tuple[str, ...] = MONITORED_TYPES
) -> DataFrame:
    """``address, part, degree, label`` of nodes with at least ``min_degree`` edges or a label of interest.

    Participations are counted by address and part (a hash of the transaction), and
    a node has a row for each part it has edges in: what joins edges of a part
    meets only that row, so the edges of a hub are spread over all parts.
    """
    edges = transactions.filter(F.col("to_address").isNotNull()).withColumn("part", edge_part(parts))
    counted = touches(edges, "part").groupBy("address", "part").agg(F.count("*").alias("edges"))
    counted = materialize(counted, "edges-by-part")
    degrees = counted.groupBy("address").agg(F.sum("edges").alias("degree"))
    named = entities.filter(F.coalesce("is_hub", F.lit(False)) | F.col("entity_type").isin(*types))
    labels = named.groupBy("address").agg(F.min(F.coalesce("entity_type", F.lit("hub"))).alias("label"))
    monitored = degrees.join(labels, "address", "left").filter(F.col("label").isNotNull() | (F.col("degree") >= min_degree))
    return counted.select("address", "part").join(monitored, "address")


def edge_part(parts: int):
    return F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")


def detect_hub(
    transactions: DataFrame,
    entities: DataFrame,
    *,
    min_degree: int,
    candidates: DataFrame | None = None,
    types: tuple[str, ...] = MONITORED_TYPES,
    parts: int | None = None,
) -> DataFrame:
    """Flags for addresses that deal with a well connected node or a labelled entity of interest.

    One row for each transaction and side whose partner is monitored: by degree
    over all of ``transactions`` (a transfer to oneself counts on both sides), or
    by its label. A transfer to oneself raises nothing. ``candidates`` are the
    transactions to judge, all if left out. The set of hubs is neither collected
    nor handed to all tasks; ``parts`` (by default the number of shuffle
    partitions) is how many tasks the edges of one hub are dealt to.
    """
    parts = parts or int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = monitored_nodes(transactions, entities, min_degree, parts, types)
    judged = (transactions if candidates is None else candidates).filter(
        F.col("to_address").isNotNull() & (F.col("from_address") != F.col("to_address"))
    )
    sides = touches(judged.withColumn("part", edge_part(parts)), "hash", "timestamp", "part")
    met = sides.withColumnsRenamed({"address": "hub", "counterparty": "address"}).join(
        nodes.withColumnRenamed("address", "hub"), ["hub", "part"]
    )
    reason = F.coalesce("label", F.format_string("node of degree %d", "degree"))
    return met.select(
        F.col("hash").alias("tx_hash"),
        "address",
        F.lit("hub_interaction").alias("flag_type"),
        F.lit("low").alias("severity"),
        F.format_string("%s interacts with %s (%s)", "address", "hub", reason).alias("description"),
        F.col("timestamp").alias("detected_at"),
        "hub",
        "degree",
    )


def mark_flagged(contracts: DataFrame, flags: DataFrame) -> DataFrame:
    """Set ``flagged`` on contracts that carry a similar-bytecode flag."""
    marked = flags.filter(F.col("flag_type") == "similar_bytecode").select("address").distinct()
    return contracts.join(marked.withColumn("_marked", F.lit(True)), "address", "left").withColumn(
        "flagged", F.col("flagged") | F.coalesce("_marked", F.lit(False))
    ).drop("_marked")

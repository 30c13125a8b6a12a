"""Every query, bound to a directory of test tables.

Each entry runs over the whole tables. Lists leave as joined text and amounts as
exact text, so that results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.functions.explanations import explain_flags
from ledgerscope.functions.fingerprint import bytecode_embedding
from ledgerscope.functions.keccak import checksum_address
from ledgerscope.operators import accounts as A
from ledgerscope.operators import detectors as D
from ledgerscope.operators import graph as G
from ledgerscope.operators import labels as L
from ledgerscope.operators import paths as P
from ledgerscope.operators import quality as Q
from ledgerscope.operators import records as R
from ledgerscope.operators import series as TS
from ledgerscope.operators import vectors as V
from ledgerscope.operators.knn import RANK_DIGITS, nearest_neighbours
from ledgerscope.operators.touches import touches
from ledgerscope.plans import documents as docs
from ledgerscope.session import materialize, scratch_path
from ledgerscope.sources import star
from ledgerscope.sources.by_address import AddressIndex
from ledgerscope.sources.ledger import Ledger
from ledgerscope.sources.seed_labels import builtin_labels
from ledgerscope.streaming import ingest as ST
from ledgerscope.streaming import jobs as SJ

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
# Similarities leave as precisely as they are ranked.
SIMILARITY_DIGITS = RANK_DIGITS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on_ledger(fn: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star.load(spark, sf_dir))

    QUERIES[fn.__name__.removeprefix("query_")] = run
    return fn


def joined(name: str, separator: str = ",") -> DataFrame:
    return F.array_join(name, separator).alias(name)


def text(*names: str):
    return [F.col(n).cast("string").alias(n) for n in names]


# ---------------------------------------------------------------- sources and sinks


@query
def ledger_projection(spark, sf_dir):
    projected = R.project_raw(star.deliveries(spark, sf_dir))
    return projected.withColumns({n: F.col(n).cast("string") for n in ("value", "gas_price")}).withColumn(
        "data", S.bytes_to_hex(F.col("data"))
    )


@query
def ledger_dedup(spark, sf_dir):
    rows = R.first_delivery(R.accepted(R.project_raw(star.deliveries(spark, sf_dir))))
    return rows.select("hash", "from_address", "to_address", *text("value"), "timestamp")


@on_ledger
def accounts_build(ledger):
    return ledger.accounts.withColumn("balance", F.col("balance").cast("string"))


@on_ledger
def jobs_enqueue(ledger):
    unfinished = ledger.jobs.filter(F.col("status") != "done")
    return R.enqueue_jobs(ledger.transactions, unfinished, ledger.as_of).select("tx_hash", "status", "attempts", "available_at")


@query
def flags_dedup(spark, sf_dir):
    """Flags raised by every delivery of a job log line: many repeat a (transaction, address, type)."""
    return R.oldest_flags(star.repeated_flags(spark, sf_dir))


@query
def flags_dedup_latest(spark, sf_dir):
    return R.newest_flags(star.repeated_flags(spark, sf_dir))


@query
def entities_seed_merge(spark, sf_dir):
    ledger = star.load(spark, sf_dir)
    seeds = builtin_labels(spark).drop("is_contract").unionByName(star.supplier_labels(spark, sf_dir))
    return L.merge_seed_labels(ledger.entities, seeds, ledger.as_of)


@on_ledger
def seeded_accounts(ledger):
    seeded = L.seed_accounts(builtin_labels(ledger.spark), ledger.accounts, ledger.as_of)
    return seeded.withColumn("balance", F.col("balance").cast("string"))


@on_ledger
def contract_vectors_build(ledger):
    stored = V.contract_vectors(ledger.bytecode)
    return stored.select(
        "address", F.octet_length("bytecode").alias("bytecode_size"), _micro_units("embedding"), "flagged"
    )


@query
def latest_bytecode(spark, sf_dir):
    """Code observed for an address: every document and every page, the later one wins."""
    documents = star.table(spark, sf_dir, "documents").select(
        star.addr(F.col("doc_id")).alias("address"), F.encode("text", "UTF-8").alias("bytecode"), F.col("n_chars").alias("observed_at")
    )
    pages = star.table(spark, sf_dir, "pages").select(
        star.addr(F.col("page_id")).alias("address"), F.encode("html", "UTF-8").alias("bytecode"), F.length("html").cast("long").alias("observed_at")
    )
    return V.latest_bytecode(documents.unionByName(pages)).select("address", S.bytes_to_hex(F.col("bytecode")).alias("bytecode"))


@on_ledger
def contracts_flagged(ledger):
    marked = D.mark_flagged(V.contract_vectors(ledger.bytecode), ledger.flags)
    return marked.select("address", "flagged")


@on_ledger
def graph_edges(ledger):
    return G.graph_edges(ledger.transactions).withColumns({n: F.col(n).cast("string") for n in ("value", "gas_price")})


@on_ledger
def graph_vertices(ledger):
    return G.graph_vertices(ledger.transactions, ledger.accounts)


@on_ledger
def contract_calls_with_code(ledger):
    return R.contract_calls(ledger.transactions, ledger.bytecode).select("hash", "from_address", "to_address", "bytecode_size")


@on_ledger
def snapshot_json(ledger):
    return docs.snapshot(ledger)


@on_ledger
def snapshot_contents(ledger):
    """Values read back from the snapshot document."""

    def number(path: str):
        return F.get_json_object("snapshot", path).cast("long")

    def listed(name: str, field: str):
        rows = F.from_json(F.get_json_object("snapshot", f"$.{name}"), f"array<struct<{field}: string>>")
        return F.array_join(F.transform(rows, lambda r: r[field]), ",")

    return docs.snapshot(ledger).select(
        number("$.overview.transaction_count").alias("transaction_count"),
        number("$.overview.account_count").alias("account_count"),
        number("$.enrichment.pending").alias("pending"),
        number("$.enrichment.max_attempts").alias("max_attempts"),
        listed("recent_transactions", "hash").alias("transactions"),
        listed("recent_flags", "id").alias("flags"),
        listed("recent_flags", "confidence").alias("confidences"),
    )


@on_ledger
def overview_page(ledger):
    return docs.overview_page(ledger)


@on_ledger
def network_history_csv(ledger):
    return TS.history_export(TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 168))


# ---------------------------------------------------------------- lookups and filters


@on_ledger
def account_lookup(ledger):
    keys = ledger.entities.select("address")
    return A.account_lookup(ledger.accounts, keys).withColumn("balance", F.col("balance").cast("string"))


@on_ledger
def tx_by_hash(ledger):
    hashes = ledger.jobs.select(F.col("tx_hash").alias("hash"))
    found = R.transactions_by_hash(ledger.transactions, hashes)
    return found.withColumns({n: F.col(n).cast("string") for n in ("value", "gas_price")}).withColumn(
        "data", S.bytes_to_hex(F.col("data"))
    )


@on_ledger
def flags_for_tx(ledger):
    return R.flags_for_transactions(ledger.flags, ledger.jobs.select(F.col("tx_hash").alias("hash")))


@on_ledger
def entities_by_addresses(ledger):
    return L.entities_by_addresses(ledger.entities, touches(ledger.transactions).select("address"))


@on_ledger
def recent_tx_per_account(ledger):
    recent = A.recent_for_accounts(ledger.transactions, 8, "from_address", "to_address", "value", "nonce")
    return recent.select("address", "position", "hash", "from_address", "to_address", *text("value"), "nonce", "timestamp")


@on_ledger
def recent_tx_window(ledger):
    return R.recent_window(ledger.transactions, ledger.as_of, 1).select("hash", "timestamp")


@on_ledger
def jobs_claimable(ledger):
    rows = R.claimable_jobs(ledger.jobs, ledger.transactions, ledger.as_of)
    return rows.select("tx_hash", "status", "attempts", "available_at", "from_address", "to_address", *text("value"))


@on_ledger
def jobs_claimable_first(ledger):
    """The fifty that come first, with their place."""
    rows = R.claimable_jobs(ledger.jobs, ledger.transactions, ledger.as_of, 50)
    place = F.row_number().over(Window.orderBy("available_at", "updated_at", "tx_hash"))
    return rows.select("tx_hash", "status", "attempts", "available_at", place.alias("place"))


@query
def jobs_latest_state(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return R.latest_job_state(star.job_events(spark, sf_dir))


@on_ledger
def circular_candidates(ledger):
    return R.circular_candidates(ledger.transactions).select("hash", "from_address", "to_address", "timestamp")


@on_ledger
def classify_search_terms(ledger):
    terms = touches(ledger.transactions, "hash").select(F.explode(F.array("hash", "address")).alias("term")).distinct()
    return terms.select("term", S.search_target(F.col("term")).alias("target"))


# ---------------------------------------------------------------- aggregates


@on_ledger
def query_touches(ledger):
    return touches(ledger.transactions, "hash").select("hash", "direction", "address", "counterparty")


@on_ledger
def address_risk(ledger):
    return L.address_risk(ledger.flags)


@on_ledger
def risk_label_first(ledger):
    return L.risk_by_label(ledger.accounts, ledger.entities, ledger.flags)


@on_ledger
def risk_flags_first(ledger):
    return L.risk_by_flags(ledger.accounts, ledger.entities, ledger.flags)


@on_ledger
def address_activity(ledger):
    return A.address_activity(ledger.account_activity)


def _listed_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns(
        {
            "counterparties": F.array_join(F.transform("counterparties", lambda c: c["counterparty"]), ","),
            "recent_transactions": F.array_join(F.transform("recent_transactions", lambda t: t["hash"]), ","),
        }
    )


@on_ledger
def account_profile(ledger):
    return _listed_profiles(docs.account_profiles(ledger, 8))


@on_ledger
def account_profile_by_keys(ledger):
    """Profiles of the labelled entities, looked up in a copy of the ledger by address."""
    index = AddressIndex(ledger.spark, scratch_path(ledger.spark, "by-address"), slots=16)
    index.write(ledger.transactions)
    keys = [r[0] for r in ledger.entities.select("address").collect()]
    return _listed_profiles(docs.account_profiles(replace(ledger, by_address=index), 8, keys))


@on_ledger
def counterparties(ledger):
    return docs.labelled_counterparties(ledger, 8)


@on_ledger
def counterparty_total(ledger):
    return docs.counterparty_total(ledger)


@on_ledger
def network_metrics(ledger):
    return TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 24)


@on_ledger
def network_metrics_daily(ledger):
    return TS.network_metrics(ledger.transactions, ledger.as_of, "day", 720)


@on_ledger
def address_velocity(ledger):
    return A.address_velocity(ledger.transactions, ledger.as_of, "hour", 72)


@on_ledger
def velocity_peak(ledger):
    return A.velocity_peak(A.address_velocity(ledger.transactions, ledger.as_of, "hour", 720))


@on_ledger
def flag_series(ledger):
    return TS.flag_series(ledger.flags, ledger.as_of, "hour", 24)


@on_ledger
def flag_series_daily(ledger):
    return TS.flag_series(ledger.flags, ledger.as_of, "day", 720)


@on_ledger
def overview_stats(ledger):
    return TS.overview_stats(ledger.transactions, ledger.accounts, ledger.flags, ledger.jobs)


@on_ledger
def enrichment_status(ledger):
    return TS.enrichment_status(ledger.jobs)


@on_ledger
def top_addresses(ledger):
    return A.top_addresses(ledger.account_activity, 20)


@on_ledger
def active_candidates(ledger):
    return A.active_candidates(ledger.transactions, 6)


@on_ledger
def behavior_stats(ledger):
    return _rounded(
        V.behavior_stats(ledger.transactions, ledger.as_of),
        "contract_call_ratio",
        "night_ratio",
        "weekend_ratio",
        "active_span_hours",
    )


@on_ledger
def node_degrees(ledger):
    return G.node_degrees(G.graph_edges(ledger.transactions))


@query
def duplicate_summary(spark, sf_dir):
    return G.duplicate_summary(star.duplicated_nodes(spark, sf_dir))


@query
def duplicate_groups(spark, sf_dir):
    return G.largest_duplicate_groups(star.duplicated_nodes(spark, sf_dir), 100)


@on_ledger
def flag_signal_delta(ledger):
    return _rounded(TS.flag_signal(R.recent_flags(ledger.flags, 50)), "signal_delta")


@on_ledger
def network_totals(ledger):
    return TS.network_totals(TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 168))


@on_ledger
def half_window_change(ledger):
    return _rounded(TS.half_window_change(TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 24)), "value_change")


@on_ledger
def compress_series(ledger):
    return TS.compress_series(TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 24), 8)


@on_ledger
def bucket_deltas(ledger):
    points = TS.network_metrics(ledger.transactions, ledger.as_of, "hour", 24)
    return _rounded(TS.bucket_deltas(points), "transaction_delta", "address_delta")


@on_ledger
def contract_queue_counts(ledger):
    return TS.contract_queue_counts(R.recent_contracts(ledger.accounts, _stored_contracts(ledger), 12))


@query
def constraint_violations(spark, sf_dir):
    """The rules over the ledger, with the repeated signals as its flags."""
    ledger = star.load(spark, sf_dir)
    flags = star.repeated_flags(spark, sf_dir).withColumn("severity", star.pick(star.SEVERITIES, F.col("id") % 3))
    return Q.constraint_violations(ledger.transactions, ledger.accounts, flags, ledger.entities, ledger.jobs)


# ---------------------------------------------------------------- top-k lists


@on_ledger
def recent_transactions(ledger):
    return R.recent_transactions(ledger.transactions, 50).withColumns(
        {n: F.col(n).cast("string") for n in ("value", "gas_price")}
    )


@on_ledger
def recent_contracts(ledger):
    return R.recent_contracts(ledger.accounts, _stored_contracts(ledger), 20)


@on_ledger
def recent_flags(ledger):
    return R.recent_flags(ledger.flags, 50)


@on_ledger
def top_features(ledger):
    rows = V.top_features(V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of)))
    shown = S.signed_value(F.round("value", 2)).alias("shown")
    return rows.select("address", "position", "feature", "label", shown)


# ---------------------------------------------------------------- scalar functions


@on_ledger
def normalize_addresses(ledger):
    """Every address in the spellings it may arrive in, one row per key."""
    name = F.col("address")
    spellings = F.array(
        name, F.concat(F.lit("  "), name), F.concat(F.lit("0X"), F.upper(F.substring(name, 3, 40))), F.substring(name, 3, 40)
    )
    keys = touches(ledger.transactions).select(F.explode(spellings).alias("spelling")).distinct()
    return keys.groupBy(S.normalize_address(F.col("spelling")).alias("address")).agg(F.count("*").alias("spellings"))


@on_ledger
def checksum_addresses(ledger):
    return ledger.accounts.select("address", checksum_address(F.col("address")).alias("checksum"))


@on_ledger
def flags_explained(ledger):
    return explain_flags(R.listed_flags(ledger.flags))


@on_ledger
def format_wei(ledger):
    return ledger.transactions.select(
        "hash", S.format_eth(F.col("value").cast("string")).alias("eth"), S.format_gwei(F.col("gas_price").cast("string")).alias("gwei")
    )


@on_ledger
def short_address(ledger):
    return ledger.transactions.select("hash", S.short_address(F.col("to_address")).alias("recipient"))


@on_ledger
def compact_count(ledger):
    return ledger.transactions.select(
        "hash", S.compact_count(F.col("gas")).alias("gas"), S.compact_count(F.col("gas_price")).alias("gas_price")
    )


@on_ledger
def percent_format(ledger):
    total = F.col("sent_count") + F.col("received_count")
    sent_share = F.when(F.col("received_count") > 0, F.round(F.col("sent_count") / total, 4))
    return ledger.account_activity.select(
        "address", S.format_percent(sent_share).alias("percent"), S.format_similarity(sent_share).alias("similarity")
    )


@on_ledger
def datetime_label(ledger):
    labels = ledger.jobs.select("tx_hash", S.datetime_label(F.col("locked_at")).alias("locked"))
    times = ledger.transactions.select(F.col("hash").alias("tx_hash"), S.datetime_label(F.col("timestamp")).alias("seen"))
    return times.join(labels, "tx_hash", "left").select("tx_hash", "seen", "locked")


@on_ledger
def payload_hex(ledger):
    return ledger.transactions.select(
        "hash",
        S.bytes_to_hex(F.col("data")).alias("binary_payload"),
        S.payload_text_to_hex(F.base64("data")).alias("text_payload"),
    )


@on_ledger
def tx_direction(ledger):
    recent = A.recent_for_accounts(ledger.transactions, 8, "from_address", "to_address")
    outbound = F.lower("from_address") == F.lower("address")
    return recent.select(
        "address",
        "hash",
        F.when(outbound, "Outbound").otherwise("Inbound").alias("side"),
        F.when(outbound, F.coalesce("to_address", F.lit("Contract creation"))).otherwise(F.col("from_address")).alias("other"),
    )


@on_ledger
def risk_text(ledger):
    labels = ledger.entities.select("address", "risk_level")
    return ledger.accounts.join(labels, "address", "left").select("address", S.risk_text(F.col("risk_level")).alias("risk"))


@on_ledger
def features_json_roundtrip(ledger):
    features = V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of))
    decoded = features.select("address", S.features_from_json(S.features_to_json(V.feature_map())).alias("features"))
    return decoded.select("address", F.size("features").alias("size"), F.round(F.col("features")["sent_count_log"], 6).alias("sent_count_log"))


# ---------------------------------------------------------------- compositions


@on_ledger
def contract_detail(ledger):
    return docs.contract_details(ledger, _stored_contracts(ledger))


@on_ledger
def tx_detail(ledger):
    return docs.transaction_details(ledger)


@on_ledger
def tx_detail_by_keys(ledger):
    """The transactions of the live list, looked up by their hashes."""
    keys = [r[0] for r in R.recent_transactions(ledger.transactions, 50).select("hash").collect()]
    return docs.transaction_details(ledger, keys)


@on_ledger
def contract_detail_by_keys(ledger):
    """Dossiers of the labelled entities that are contracts."""
    keys = [r[0].upper().replace("0X", "0x") for r in ledger.entities.select("address").collect()]
    return docs.contract_details(ledger, _stored_contracts(ledger), keys)


@on_ledger
def tx_related_flag(ledger):
    return R.related_flag(ledger.transactions, ledger.flags)


# ---------------------------------------------------------------- graph


@on_ledger
def return_paths(ledger):
    edges = G.graph_edges(ledger.transactions)
    found = P.return_paths(edges, edges)
    return found.select("from_address", "to_address", "hops", joined("path"), joined("hashes"))


def _traces_to_hub(ledger: Ledger) -> DataFrame:
    """How every account reaches the best connected node."""
    edges = G.graph_edges(ledger.transactions)
    hub = G.node_degrees(edges).orderBy(F.desc("degree"), "address").first()
    requests = ledger.accounts.select(F.col("address").alias("src"), F.lit(hub["address"] if hub else None).cast("string").alias("dst"))
    return P.shortest_paths(edges, requests)


@on_ledger
def trace_path(ledger):
    found = _traces_to_hub(ledger)
    return found.select(F.col("src").alias("from_address"), F.col("dst").alias("to_address"), "hops", joined("path"), joined("hashes"))


@on_ledger
def trace_edges(ledger):
    steps = P.trace_edges(_traces_to_hub(ledger), G.graph_edges(ledger.transactions))
    return steps.select("src", "dst", (F.col("step") + 1).alias("step"), "hash", "from_address", "to_address", *text("value"), "timestamp")


@on_ledger
def circular_flows(ledger):
    flows = P.circular_flows(G.graph_edges(ledger.transactions), 100)
    return flows.select("hops", joined("path"), joined("hashes"))


@on_ledger
def circular_flows_three(ledger):
    flows = P.circular_flows(G.graph_edges(ledger.transactions), 100, shortest=3)
    return flows.select("hops", joined("path"), joined("hashes"))


def _paths(ledger: Ledger) -> DataFrame:
    return G.neighbourhood_paths(G.graph_edges(ledger.transactions), ledger.accounts.select("address"), 2, 50)


def _neighbourhood_nodes(ledger: Ledger, paths: DataFrame) -> DataFrame:
    edges, centers = G.graph_edges(ledger.transactions), ledger.accounts.select("address")
    return G.address_graph_nodes(paths, edges, centers, ledger.accounts, ledger.entities, ledger.flags)


@on_ledger
def address_graph(ledger):
    ledger = ledger.with_stored_accounts()
    graphs = G.address_graph(_paths(ledger), ledger.accounts.select("address"), ledger.accounts)
    return graphs.select(
        "center",
        F.array_join("nodes", ",").alias("nodes"),
        F.array_join(F.transform("edges", lambda e: e["hash"]), ",").alias("edges"),
    )


@on_ledger
def address_graph_nodes(ledger):
    ledger = ledger.with_stored_accounts()
    return _neighbourhood_nodes(ledger, _paths(ledger))


@on_ledger
def graph_counters(ledger):
    ledger = ledger.with_stored_accounts()
    paths = _paths(ledger)
    return G.graph_counters(_neighbourhood_nodes(ledger, paths), G.graph_members(paths)[1])


@on_ledger
def graph_node_priority(ledger):
    ledger = ledger.with_stored_accounts()
    return G.labelled_nodes(_neighbourhood_nodes(ledger, _paths(ledger)))


@on_ledger
def top_hubs(ledger):
    return G.top_hubs(ledger.transactions, ledger.accounts, ledger.entities, ledger.flags, 8)


@query
def merge_duplicate_vertices(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    nodes, _ = G.merge_duplicates(star.duplicated_nodes(spark, sf_dir), star.duplicated_edges(spark, sf_dir))
    return nodes


@query
def merge_duplicate_edges(spark, sf_dir):
    nodes = materialize(star.duplicated_nodes(spark, sf_dir), "nodes")
    _, edges = G.merge_duplicates(nodes, star.duplicated_edges(spark, sf_dir))
    return edges


# ---------------------------------------------------------------- vectors


@on_ledger
def query_bytecode_embedding(ledger):
    rows = ledger.bytecode.filter("has_code")
    return rows.select("address", _micro_units(bytecode_embedding(F.col("bytecode"))))


@query
def cosine_pairs(spark, sf_dir):
    """Every embedding against the first one of its label."""
    vectors = star.table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    heads = first.join(vectors.select(F.col("vec_id").alias("first_id"), F.col("embedding").alias("head")), "first_id")
    similarity = F.round(S.cosine_similarity(F.col("embedding"), F.col("head")), SIMILARITY_DIGITS)
    return vectors.join(heads, "label").select("vec_id", "first_id", similarity.alias("similarity"))


def _nearest_embeddings(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    vectors = star.table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 19, "0").alias("id"), F.col("embedding").alias("vector")
    )
    found = nearest_neighbours(vectors, None, 5, **how)
    return _rounded(
        found.select(F.col("id").cast("long").alias("vec_id"), F.col("neighbour").cast("long").alias("match"), "position", "similarity"),
        "similarity",
        digits=SIMILARITY_DIGITS,
    )


@query
def knn_embeddings(spark, sf_dir):
    return _nearest_embeddings(spark, sf_dir)


@query
def knn_embeddings_tiles(spark, sf_dir):
    """The same by the way taken for pools of any size: a grid of tiles, here of 400 vectors a side."""
    return _nearest_embeddings(spark, sf_dir, scan_numbers=0, tile_rows=400)


@on_ledger
def similar_contracts(ledger):
    found = V.similar_contracts(_flagged_contracts(ledger), 5)
    return _rounded(found, "similarity", digits=SIMILARITY_DIGITS)


@on_ledger
def similar_bytecode(ledger):
    """Page sources as samples against the stored contracts."""
    samples = ledger.metadata.select("address", F.encode("source_code", "UTF-8").alias("bytecode"))
    found = V.similar_bytecode(samples, _flagged_contracts(ledger), 5)
    return _rounded(found, "similarity", digits=SIMILARITY_DIGITS)


def _features(ledger: Ledger) -> DataFrame:
    return V.behavior_features(V.behavior_stats(ledger.transactions, ledger.as_of))


@on_ledger
def behavior_features(ledger):
    return _rounded(_features(ledger), *V.FEATURES)


@on_ledger
def behavior_profiles(ledger):
    profiles = V.behavior_profiles(_features(ledger), ledger.accounts, ledger.entities, ledger.flags)
    return profiles.withColumn("features", F.size("features"))


@on_ledger
def behavior_embedding(ledger):
    vectors = V.with_embedding(_features(ledger))
    return vectors.select("address", F.size("embedding").alias("dims"), _micro_units("embedding"))


@on_ledger
def behavior_vectors_upsert(ledger):
    """Vectors as of half the ledger and, after a second upsert of those that moved, of all of it; the first is read last."""
    spark, middle = ledger.transactions.sparkSession, ledger.as_of - timedelta(days=15)
    stored = V.behavior_store(spark, scratch_path(spark, "behavior-vectors"))
    V.upsert_behavior(stored, ledger.transactions.filter(F.col("timestamp") <= F.lit(middle)), ledger.as_of)
    first = stored.read()
    V.upsert_behavior(stored, ledger.transactions, ledger.as_of, since=middle)
    versions = first.select("*", F.lit(0).alias("version")).unionByName(stored.read().select("*", F.lit(1).alias("version")))
    return versions.select("version", "address", "sample_size", _micro_units("embedding"))


def _similar_accounts(ledger: Ledger) -> DataFrame:
    return V.similar_accounts(_features(ledger), ledger.accounts, ledger.entities, ledger.flags, 6)


@on_ledger
def similar_accounts(ledger):
    return _rounded(_similar_accounts(ledger).drop("highlights"), "similarity", digits=SIMILARITY_DIGITS)


@on_ledger
def similar_active_accounts(ledger):
    """Every account against the pool of most active ones."""
    pool = A.active_candidates(ledger.transactions, 6)
    found = V.similar_accounts(_features(ledger), ledger.accounts, ledger.entities, ledger.flags, 6, pool)
    return _rounded(found.select("address", "match", "position", "similarity"), "similarity", digits=SIMILARITY_DIGITS)


@on_ledger
def behavior_highlights(ledger):
    return _similar_accounts(ledger).select("address", "match", joined("highlights", "; "))


# ---------------------------------------------------------------- detectors


@on_ledger
def detect_circular(ledger):
    return D.detect_circular(ledger.transactions)


@on_ledger
def detect_similar_bytecode(ledger):
    contracts = materialize(V.contract_vectors(ledger.bytecode).select("address", "embedding"), "contract-vectors")
    called = R.contract_calls(ledger.transactions, ledger.bytecode).select(F.col("to_address").alias("address"))
    nearest = V.nearest_stored(contracts.join(called, "address", "left_semi"), contracts, D.SIMILAR_DISTANCE)
    flags = D.detect_similar_bytecode(ledger.transactions, ledger.bytecode, nearest)
    return _rounded(flags, "similarity", digits=SIMILARITY_DIGITS)


@on_ledger
def detect_velocity(ledger):
    return D.detect_velocity(ledger.transactions, ratio=3, minimum=5)


@on_ledger
def detect_velocity_sensitive(ledger):
    """Two in an hour are enough: the test tables are too quiet for many hours of five."""
    return D.detect_velocity(ledger.transactions, ratio=3, minimum=2)


@on_ledger
def detect_high_value(ledger):
    found = D.detect_high_value(ledger.transactions, threshold=10**18)
    return found.withColumn("value", F.col("value").cast("string"))


@on_ledger
def detect_hub(ledger):
    return D.detect_hub(ledger.transactions, ledger.entities, min_degree=100)


# ---------------------------------------------------------------- streaming


@query
def stream_ingest(spark, sf_dir):
    return ST.run_ingest(spark, sf_dir)


@query
def stream_enrich(spark, sf_dir):
    return ST.run_enrichment(spark, sf_dir)


@query
def stream_retry(spark, sf_dir):
    return SJ.run_jobs(spark, sf_dir)


@query
def stream_network_metrics(spark, sf_dir):
    return ST.run_network_metrics(spark, sf_dir)


# ---------------------------------------------------------------- helpers


def _stored_contracts(ledger: Ledger) -> DataFrame:
    """Stored code with marks, without computing fingerprints that are not shown."""
    coded = ledger.bytecode.filter("has_code").withColumn("flagged", F.lit(False))
    return D.mark_flagged(coded, ledger.flags)


def _flagged_contracts(ledger: Ledger) -> DataFrame:
    return D.mark_flagged(V.contract_vectors(ledger.bytecode), ledger.flags)


def _micro_units(embedding):
    """An embedding as whole millionths."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    return F.array_join(F.transform(column, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",").alias("embedding")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})

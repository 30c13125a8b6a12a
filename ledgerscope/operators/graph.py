"""The transfer graph: vertices, edges, degrees, neighbourhoods, duplicate repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.operators.labels import address_risk, join_labels
from ledgerscope.operators.touches import distinct_touches, touches
from ledgerscope.session import materialize

# A node with this many edges inside a displayed neighbourhood counts as a hub.
LOCAL_HUB_DEGREE = 4


def graph_edges(transactions: DataFrame) -> DataFrame:
    """One directed edge per transaction with a recipient."""
    return transactions.filter(F.col("to_address").isNotNull()).select(
        "hash", "from_address", "to_address", "value", "gas", "gas_price", "nonce", "block_number", "timestamp"
    )


def graph_vertices(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ends of edges with their first and last edge time."""
    edges = graph_edges(transactions)
    seen = (
        touches(edges, "timestamp")
        .groupBy("address")
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )
    contracts = accounts.filter("is_contract").select("address", F.lit(True).alias("contract"))
    return seen.join(contracts, "address", "left").select(
        "address", F.coalesce("contract", F.lit(False)).alias("is_contract"), "first_seen", "last_seen"
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """Out, in and total edges per node; a self-loop counts on both sides."""
    return (
        touches(edges)
        .groupBy("address")
        .agg(
            F.count_if(F.col("direction") == "out").alias("out_degree"),
            F.count_if(F.col("direction") == "in").alias("in_degree"),
            F.count("*").alias("degree"),
        )
    )


def top_hubs(
    transactions: DataFrame, accounts: DataFrame, entities: DataFrame, flags: DataFrame, limit: int | None = None
) -> DataFrame:
    """The best connected nodes. Labels are looked up for the listed nodes only."""
    n = S.clamp_limit(limit, 8, 50)
    hubs = (
        node_degrees(graph_edges(transactions))
        .orderBy(F.desc("degree"), F.desc("out_degree"), F.desc("in_degree"), "address")
        .limit(n)
    )
    listed = hubs.join(accounts.select("address", "is_contract"), "address", "left")
    return join_labels(listed, entities, address_risk(flags)).select(
        "address",
        "out_degree",
        "in_degree",
        "degree",
        F.coalesce("is_contract", F.lit(False)).alias("is_contract"),
        F.coalesce("label_name", F.lit("")).alias("entity_name"),
        S.entity_type_or_default(F.col("label_type"), F.col("is_contract")).alias("entity_type"),
        S.risk_flags_first(F.col("label_risk"), F.col("flag_risk")).alias("risk_level"),
        F.lit(True).alias("is_hub"),
        F.col("label_updated_at").alias("updated_at"),
    )


# ---------------------------------------------------------------- neighbourhoods


def neighbourhood_paths(edges: DataFrame, centers: DataFrame, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Per center, the first ``limit`` undirected trails of up to ``depth`` edges.

    Trails are ordered by length, then by their edge hashes; an edge is used at
    most once. A trail never needs more than the first ``limit + depth - 1`` edges
    of a node, because at most ``depth - 1`` of them can be used up already. Cut to
    those, no node is expanded by more rows than that, however many edges it has.
    """
    hops, n = S.clamp_depth(depth), S.clamp_limit(limit, 50, 200)
    detail = F.struct("hash", "from_address", "to_address", "value", "timestamp")
    sides = distinct_touches(edges.withColumn("edge", detail), "edge").select(
        F.col("address").alias("node"), F.col("counterparty").alias("other"), "edge"
    )
    by_hash = Window.partitionBy("node").orderBy("edge.hash")
    first_edges = (
        sides.withColumn("position", F.row_number().over(by_hash)).filter(F.col("position") <= n + hops - 1).drop("position")
    )
    if hops > 1:
        first_edges = materialize(first_edges, "first-edges")
    level = (
        centers.select(F.col("address").alias("center"))
        .join(first_edges, F.col("center") == F.col("node"))
        .select(
            "center",
            F.col("other").alias("tip"),
            F.array("edge").alias("edges"),
            F.array("node", "other").alias("nodes"),
        )
    )
    found = materialize(_first_trails(level, n), "trails1")
    sizes = first_edges.groupBy(F.col("node").alias("tip")).agg(F.count("*").alias("tip_edges"))
    for length in range(2, hops + 1):
        # A center that reached its limit is done; the others know all their shorter trails.
        # Longer trails follow the order of their beginnings, so beginnings are extended only
        # until those before them already yield all trails that are missing.
        missing = found.groupBy("center").agg((F.lit(n) - F.count("*")).alias("missing")).filter("missing > 0")
        used_at_tip = F.size(F.filter("edges", lambda e: (e["from_address"] == F.col("tip")) | (e["to_address"] == F.col("tip"))))
        earlier = _trail_order().rowsBetween(Window.unboundedPreceding, -1)
        frontier = (
            found.filter(F.size("edges") == length - 1)
            .join(missing, "center")
            .join(sizes, "tip")
            .withColumn("ways", F.col("tip_edges") - used_at_tip)
            .filter("ways > 0")
            .withColumn("before", F.coalesce(F.sum("ways").over(earlier), F.lit(0)))
            .filter("before < missing")
        )
        longer = (
            frontier.join(first_edges, F.col("tip") == F.col("node"))
            .filter(~F.exists("edges", lambda e: e["hash"] == F.col("edge.hash")))
            .select(
                "center",
                F.col("other").alias("tip"),
                F.array_append("edges", F.col("edge")).alias("edges"),
                F.array_append("nodes", F.col("other")).alias("nodes"),
            )
        )
        found = materialize(_first_trails(found.unionByName(_first_trails(longer, n)), n), f"trails{length}")
    return found.drop("tip")


def _trail_order() -> WindowSpec:
    return Window.partitionBy("center").orderBy(F.size("edges"), F.transform("edges", lambda e: e["hash"]))


def _first_trails(paths: DataFrame, n: int) -> DataFrame:
    return paths.withColumn("_n", F.row_number().over(_trail_order())).filter(F.col("_n") <= n).drop("_n")


def graph_members(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (center, node) and (center, edge) rows of the trails."""
    nodes = paths.select("center", F.explode("nodes").alias("node")).distinct()
    edges = paths.select("center", F.inline("edges")).dropDuplicates(["center", "hash"])
    return nodes, edges


def address_graph_nodes(
    paths: DataFrame, edges: DataFrame, centers: DataFrame, accounts: DataFrame, entities: DataFrame, flags: DataFrame
) -> DataFrame:
    """Labelled nodes of each neighbourhood; ``paths`` comes from ``neighbourhood_paths``.

    A center without edges is shown alone, as its account profile describes it.
    """
    nodes, shown = graph_members(paths)
    ends = shown.select("center", F.explode(F.array("from_address", "to_address")).alias("node"))
    degrees = ends.groupBy("center", "node").agg(F.count("*").alias("degree"))
    risk = address_risk(flags)
    facts = join_labels(accounts.select("address", "is_contract"), entities, risk).withColumnRenamed("address", "node")
    contract = F.coalesce("is_contract", F.lit(False))
    degree = F.coalesce("degree", F.lit(0))
    inside = (
        nodes.join(degrees, ["center", "node"], "left")
        .join(facts, "node", "left")
        .select(
            "center",
            "node",
            contract.alias("is_contract"),
            F.coalesce("label_name", F.lit("")).alias("entity_name"),
            S.entity_type_or_default(F.col("label_type"), contract).alias("entity_type"),
            S.risk_flags_first(F.col("label_risk"), F.col("flag_risk")).alias("risk_level"),
            (F.coalesce("label_hub", F.lit(False)) | (degree >= LOCAL_HUB_DEGREE)).alias("is_hub"),
            degree.alias("degree"),
        )
    )
    # The trails already tell which centers have edges.
    alone = centers.select(F.col("address").alias("node")).join(
        paths.select(F.col("center").alias("node")).distinct(), "node", "left_anti"
    )
    # The stand-alone node goes through the same label step, which lets flag risk override.
    single = alone.join(facts, "node").select(
        F.col("node").alias("center"),
        "node",
        contract.alias("is_contract"),
        F.coalesce("label_name", F.lit("")).alias("entity_name"),
        S.entity_type_or_default(F.col("label_type"), contract).alias("entity_type"),
        S.risk_flags_first(
            S.risk_label_first(F.col("label_risk"), F.col("flag_risk")), F.col("flag_risk")
        ).alias("risk_level"),
        F.coalesce("label_hub", F.lit(False)).alias("is_hub"),
        F.lit(0).cast("long").alias("degree"),
    )
    return inside.unionByName(single)


def address_graph(paths: DataFrame, centers: DataFrame, accounts: DataFrame) -> DataFrame:
    """One document per center with its nodes and edges. Both lists are bounded by the path limit."""
    nodes, shown = graph_members(paths)
    node_lists = nodes.groupBy("center").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    edge_lists = shown.groupBy("center").agg(
        F.array_sort(F.collect_list(F.struct("hash", "from_address", "to_address", "value", "timestamp"))).alias("edges")
    )
    known = centers.join(accounts.select("address"), "address", "left_semi").select(F.col("address").alias("center"))
    no_edges = F.array().cast(edge_lists.schema["edges"].dataType)
    return (
        known.join(node_lists, "center", "left")
        .join(edge_lists, "center", "left")
        .select("center", F.coalesce("nodes", F.array("center")).alias("nodes"), F.coalesce("edges", no_edges).alias("edges"))
    )


def graph_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per neighbourhood: grave nodes, contracts, edges."""
    per_node = nodes.groupBy("center").agg(
        F.count_if(F.col("risk_level") == "high").alias("flagged_nodes"),
        F.count_if("is_contract").alias("contract_nodes"),
    )
    per_edge = edges.groupBy("center").agg(F.count("*").alias("visible_edges"))
    return per_node.join(per_edge, "center", "left").select(
        "center", "flagged_nodes", "contract_nodes", F.coalesce("visible_edges", F.lit(0)).alias("visible_edges")
    )


def display_priority(center: Column, node: Column) -> Column:
    """Fixed weights: 1000 for the center, else degree plus 120 hub, 90 grave, 24 contract."""
    weight = (
        F.col("degree")
        + F.when(F.col("is_hub"), 120).otherwise(0)
        + F.when(F.lower("risk_level") == "high", 90).otherwise(0)
        + F.when(F.col("is_contract"), 24).otherwise(0)
    )
    return F.when(node == center, F.lit(1000)).otherwise(weight)


def labelled_nodes(nodes: DataFrame) -> DataFrame:
    """Which nodes of a neighbourhood get a caption: all of ten, else the nine weightiest."""
    per_center = Window.partitionBy("center")
    ranked = nodes.withColumn("priority", display_priority(F.col("center"), F.col("node")).cast("long"))
    order = per_center.orderBy(F.desc("priority"), "node")
    size = F.count("*").over(per_center)
    budget = F.when(size <= 10, size).otherwise(9)
    return ranked.withColumns({"position": F.row_number().over(order), "budget": budget}).select(
        "center", "node", "priority", (F.col("position") <= F.col("budget")).alias("labelled")
    )


# ---------------------------------------------------------------- duplicate nodes


def duplicate_groups(nodes: DataFrame) -> DataFrame:
    """Addresses that own more than one node, with the number of nodes."""
    return (
        nodes.groupBy(S.normalize_address(F.col("address")).alias("address"))
        .agg(F.count("*").alias("nodes"))
        .filter("nodes > 1")
    )


def duplicate_summary(nodes: DataFrame) -> DataFrame:
    return duplicate_groups(nodes).agg(
        F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("nodes") - 1), F.lit(0)).alias("extra_nodes")
    )


def largest_duplicate_groups(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """Node ids of the largest groups, one row per node, so no group is held in one row."""
    largest = duplicate_groups(nodes).orderBy(F.desc("nodes"), "address").limit(limit).withColumnRenamed("nodes", "size")
    keyed = nodes.select(S.normalize_address(F.col("address")).alias("address"), "node_id")
    return keyed.join(largest, "address").select("address", "size", "node_id")


def merge_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node per address (the lowest id), with every edge re-pointed to it.

    Edges that become equal by ends and hash are kept once.
    """
    keyed = nodes.withColumn("address", S.normalize_address(F.col("address")))
    merged = keyed.groupBy("address").agg(
        F.min("node_id").alias("node_id"),
        F.bool_or(F.coalesce("is_contract", F.lit(False))).alias("is_contract"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    mapping = keyed.select("address", F.col("node_id").alias("old_id")).join(
        merged.select("address", F.col("node_id").alias("new_id")), "address"
    )
    moved = mapping.filter("old_id <> new_id").select("old_id", "new_id")

    def repoint(df: DataFrame, end: str) -> DataFrame:
        target = moved.select(F.col("old_id").alias(end), "new_id")
        return df.join(target, end, "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")

    repaired = repoint(repoint(edges, "from_id"), "to_id").dropDuplicates(["from_id", "hash", "to_id"])
    return merged.select("node_id", "address", "is_contract", "first_seen", "last_seen"), repaired

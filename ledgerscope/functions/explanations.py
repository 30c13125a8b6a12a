"""What each type of flag means to an analyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["why_flagged", "trigger_logic", "confidence", "provenance", "next_action"]

# The explanation texts, in the order of COLUMNS.
EXPLANATIONS = {
    "circular_flow": (
        "Value appears to leave an address and then return to the origin through a short multi-hop path.",
        "Raised when graph traversal finds a bounded return path back to the same address within the configured circular-flow depth.",
        "medium",
        "Neo4j circular-flow detector",
        "Inspect the full path in Flow Canvas and compare hop timing, counterparties, and value symmetry.",
    ),
    "similar_bytecode": (
        "The contract bytecode strongly resembles another contract family already observed in the dataset.",
        "Raised when bytecode vector similarity crosses the configured nearest-neighbor threshold for suspicious contract families.",
        "medium",
        "pgvector contract-similarity matcher",
        "Open the contract intelligence route, inspect the nearest matches, and compare source or decompiled behavior.",
    ),
    "velocity_spike": (
        "The address is transacting much faster than its recent historical baseline.",
        "Raised when short-window transaction counts exceed baseline activity by the configured spike ratio and minimum event count.",
        "medium",
        "PostgreSQL velocity baseline query",
        "Compare the address dossier's recent velocity buckets and counterparties before escalation.",
    ),
    "high_value_transfer": (
        "A transfer amount exceeded the configured high-value threshold for manual review.",
        "Raised when transfer value crosses the detector's configured value threshold.",
        "low",
        "Transaction enrichment rules",
        "Validate the entity labels on sender and recipient and inspect any linked contracts or flags.",
    ),
    "hub_interaction": (
        "The address is interacting with a highly connected hub or curated entity of interest.",
        "Raised when a transaction touches a node labeled as a hub, bridge, exchange, mixer, or other monitored entity.",
        "low",
        "Entity-label enrichment and graph degree analysis",
        "Check the entity label, the transaction purpose, and whether the interaction is typical for this address.",
    ),
}
DEFAULT_EXPLANATION = (
    "A configured forensic heuristic observed behavior that diverges from the platform's normal pattern expectations.",
    "Raised when the detector for this flag type reports suspicious behavior for the transaction or address under review.",
    "medium",
    "Ledger heuristic engine",
    "Review the surrounding transactions, linked entities, and graph context before escalating.",
)


def _text(flag_type: Column, position: int) -> Column:
    # The catalogue has a handful of literal rows, so a lookup expression replaces a join.
    text = F.lit(DEFAULT_EXPLANATION[position])
    for name, texts in EXPLANATIONS.items():
        text = F.when(flag_type == name, texts[position]).otherwise(text)
    return text


def explain_flags(flags: DataFrame) -> DataFrame:
    """Add the five explanation columns."""
    flag_type = F.col("flag_type")
    return flags.withColumns({name: _text(flag_type, i) for i, name in enumerate(COLUMNS)})

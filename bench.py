"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from ledgerscope.session import build_session  # noqa: E402

HEADLINE = [
    "ledger_dedup",
    "accounts_build",
    "top_addresses",
    "account_profile",
    "counterparties",
    "recent_tx_per_account",
    "network_metrics",
    "network_metrics_daily",
    "address_velocity",
    "flag_series_daily",
    "overview_stats",
    "jobs_claimable",
    "jobs_latest_state",
    "flags_dedup",
    "tx_detail",
    "contract_detail",
    "top_hubs",
    "address_graph_nodes",
    "return_paths",
    "trace_path",
    "circular_flows",
    "merge_duplicate_edges",
    "behavior_features",
    "similar_accounts",
    "bytecode_embedding",
    "similar_contracts",
    "knn_embeddings",
    "detect_circular",
    "detect_similar_bytecode",
    "stream_ingest",
    "stream_network_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    work = tempfile.mkdtemp(prefix="ledgerscope-bench-")
    spark = build_session(
        "ledgerscope-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": work,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ledgerscope.plans.catalog import QUERIES

    QUERIES["overview_stats"](spark, sf_dir).collect()  # start the JVM's compilers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # Every row is produced and every column computed, as a sink would need them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()

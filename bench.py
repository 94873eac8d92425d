"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["search_name_kind", "search_name", "search_prefix", "search_joined_names", "search_blanks_give_all", "batch_search", "score_rules", "incremental_refresh", "evict_declarations", "upsert_records", "delta_counts", "prune_deleted", "extract_declarations", "parse_requests", "tokenize"]
#: Timed once and reported, but not part of the sum, which stays comparable: they write files, snapshots and streams of their own.
OTHERS = ["extract_constructs", "numbered_declarations", "build_from_tree", "scan_source_tree", "snapshot_round_trip", "replay_requests", "event_feed", "json_snapshot_parts", "ignore_many_rules", "log_folded", "extract_table_function"]


def operators(spark, sf_dir: str, timed) -> None:
    """Operators apart from their set-up: files are written, tables clustered and the index built before the clock starts."""
    from pyspark.sql import functions as F

    from brindle import testbed
    from brindle.plans import topk
    from brindle.queries import _tree
    from brindle.sources.shared import shared_folder
    from brindle.streaming import replay, service

    index = service.Index(spark, _tree(spark, sf_dir), cache=False)
    timed("operator_build", index.build, 1)
    paths = testbed.table(spark, sf_dir, "customer").where("c_custkey <= 100").select(F.concat(F.lit("gen/c"), F.col("c_custkey").cast("string"), F.lit(".cpp")).alias("path"))
    timed("operator_100_events", lambda: index.refresh_files(paths), 3)
    timed("operator_single_file", lambda: index.refresh_file("gen/c7.cpp"), 5)
    timed("operator_search", lambda: index.search("account7 class", 20), 5)
    timed("operator_refresh", index.refresh, 1)
    timed("operator_replay", lambda: replay.answered(index, replay.numbered(testbed.replay_lines(spark, sf_dir), ["event_id"])).count(), 1)
    folder = f"{shared_folder(spark, 'clustered')}/t"
    topk.save_clustered(testbed.declarations(spark, sf_dir), folder, 64)
    table = topk.Clustered.open(spark, folder)
    timed("operator_topk_prefix", lambda: topk.search_clustered(table, "redW", 40).collect(), 3)
    timed("operator_topk_subsequence", lambda: topk.search_clustered(table, "sg struct", 50).collect(), 3)


def main() -> None:
    from pyspark.sql import SparkSession

    from brindle import testbed
    from brindle.plans import search
    from brindle.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, rounds: int = 3) -> None:
        runs = []
        for _ in range(rounds):
            t = time.perf_counter()
            run()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 4)

    for q in HEADLINE:
        timed(q, lambda q=q: QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save())
    cached = testbed.declarations(spark, sf_dir).coalesce(2).cache()
    cached.count()
    timed("cached_search", lambda: search(cached, "rw struct").collect(), 5)
    total = sum(times.values())
    for q in OTHERS:
        timed(q, lambda q=q: QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save(), 1)
    operators(spark, sf_dir, timed)
    if find_spec("brindle.llm"):
        from brindle.llm.queries import QUERIES as LLM

        for q in LLM:
            timed(q, lambda q=q: LLM[q](spark, sf_dir).write.format("noop").mode("overwrite").save(), 1)
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

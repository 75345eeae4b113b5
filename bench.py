"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``store_build`` makes the stored fingerprints and sketches that the later queries read. Each query runs twice: ``queries`` has
the first run of each, of which ``value`` is the sum, ``warm`` the second.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from echoquorum.plans.registry import QUERIES
from echoquorum.sources import adapters

HEADLINE = [
    "top_shows", "contributions_by_day", "episode_tiers", "growth_cumulative", "disc_canonical", "disc_top_shows", "dedupe_contributions",
    "retract_rederive", "document_frequency", "minhash_sketch", "consensus_hashes", "consensus_deltas", "identify", "anti_poison_verdict",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the session's threads
    took, warm = {}, {}
    began = time.time()
    for table in (adapters.catalogue, adapters.fingerprints):
        table(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took["store_build"] = round(time.time() - began, 3)
    for times in (took, warm):
        for name in HEADLINE:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, first run of each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
